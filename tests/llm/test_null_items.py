"""Benchmark rows without an id are searched as others are."""

from claimscope.llm import inverted_index


def test_items_without_id_hit(spark):
    said = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"before {said} after"), (2, "w0 w1"), (3, None), (4, "x y z")], "doc_id long, text string")
    items = spark.createDataFrame([(None, said), (None, "w0 w1"), (7, "y"), (8, None)], "item_id long, text string")
    found = {r["doc_id"]: (r["n_hit"], r["n_items"], r["items"]) for r in inverted_index.contamination(docs, items).collect()}
    assert found == {1: (12, 1, []), 2: (2, 1, []), 3: (0, 0, []), 4: (1, 1, ["7"])}
    assert [r["doc_id"] for r in inverted_index.without_contaminated(docs, items).collect()] == [3]
