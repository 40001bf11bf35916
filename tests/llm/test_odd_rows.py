"""Columns whose names clash with helpers, rows without ids, languages of few texts."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from claimscope.llm import fertility, inverted_index, secrets_forest, simhash, tables
from tests.llm.test_operators import PROSE, odd

#: Names that operators use for columns of their own, now or before.
NAMES = (
    "__kept __hash __secret __id __mark __gone_id __gone_mark kept_id kept_hash hit_id hit_mark secret gone_id gone_mark "
    "mark fingerprint component_id lang_pred n n_words n_hit n_items items found findings row range judged"
).split()


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    docs = odd(spark).withColumns({name: F.lit(name) for name in NAMES})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        assert made.columns == docs.columns, name
        assert all(r[c] == c for r in made.collect() for c in NAMES), name
    copies = docs.unionAll(docs)
    kept = simhash.without_copies(copies, one_per_id=False)
    assert kept.columns == docs.columns and kept.count() == simhash.without_copies(docs, one_per_id=False).count()


def test_rows_without_id_are_told_apart(spark):
    many = spark.range(120_000).select(F.lit(None).cast("long").alias("doc_id"), F.format_string("text %d", "id").alias("text"))
    gone = many.limit(1).select("doc_id", tables.text_mark(F.col("text")).alias("mark"))
    assert tables.without_rows(many, gone, "doc_id", "text").count() == 119_999
    assert many.select(tables.text_mark(F.col("text"))).distinct().count() == 120_000


def test_contaminated_rows_without_id(spark):
    docs = spark.createDataFrame([(None, PROSE), (None, "clean words only"), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, " ".join(PROSE.split()[5:17]))], "item_id long, text string")
    assert [r["text"] for r in inverted_index.without_contaminated(docs, items, phrase_words=10).orderBy("text").collect()] == [None, "clean words only"]


def test_secrets_of_rows_without_id(spark):
    rows = [(None, "password: hunter2xQ!9"), (None, "nothing here"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert secrets_forest.redacted(docs).count() == 3


def test_a_language_of_one_text_has_the_band_of_all(spark):
    common = "the house was old and people came from many other places to see how water ran under this long bridge".split()
    plain = [(i, " ".join(random.Random(i * 100 + j).choice(common) for j in range(120)), "en") for i in range(80)]
    docs = spark.createDataFrame(plain + [(900, " ".join("%%&&$$##|<>" + "".join(chr(33 + (i * j) % 90) for j in range(9)) for i in range(60)), "xx")], "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in fertility.quality(docs).collect()}
    assert len(out) == 81 and not out[900]["kept"] and out[900]["outside"]
    assert sum(r["kept"] for r in out.values()) >= 70
