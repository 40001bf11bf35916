"""Claims from tables with ties, nulls and missing lines; lines are read and shuffled once."""

import datetime

import pytest

from claimscope.sources.tables import read_claims

DAY = datetime.datetime(2001, 5, 3)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("ingest"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    put(
        "orders", [(1, 5, 100.0, DAY, "1-URGENT"), (2, 6, 200.0, DAY, "2-HIGH"), (3, None, 300.0, None, None), (None, 5, 400.0, DAY, "2-HIGH"), (1, 5, 100.0, DAY, "1-URGENT")],
        "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    )
    put(
        "lineitem",
        [
            (1, 8, 7, 2, 3.0, 9.0, DAY), (1, 4, 9, 1, 5.0, 9.0, DAY + datetime.timedelta(days=2)), (1, 4, 9, 1, 5.0, 9.0, DAY),
            (2, 1, None, 1, 2.0, 1.0, DAY), (2, 1, 57, 1, 2.0, 1.0, None), (None, 2, 2, 1, 1.0, 1.0, DAY), (None, 3, 3, 2, 1.0, 1.0, DAY),
        ],
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate timestamp",
    )
    put("customer", [(5, "AUTOMOBILE"), (6, None)], "c_custkey long, c_mktsegment string")
    put("supplier", [(9, 1), (57, None)], "s_suppkey long, s_nationkey long")
    put("nation", [(1, "PERU")], "n_nationkey long, n_name string")
    put("documents", [(0, "a"), (1, "b")], "doc_id long, text string")
    return folder


def test_first_and_second_line(spark, tables):
    wanted = ["billed_amount", "provider_id", "referred_to_provider", "provider_specialty", "claim_type", "fill_date", "days_supply", "quantity", "diagnosis_codes"]
    found = sorted((float(r[0]), *r[1:]) for r in read_claims(spark, tables, *wanted).collect())
    nulls = (None,) * 3
    tied = (2.5, "PRV-00009", "PRV-00009", "PERU", "auto", DAY.date(), 20, 200, ["J00", "S13.4XXA"])
    assert found == [
        tied, tied,
        (5.0, None, "PRV-00057", None, "professional", DAY.date(), 20, 80, ["M79.3"]),
        (7.5, *nulls, "professional", None, None, None, None),
        (10.0, *nulls, "auto", None, None, None, None),
    ]


def test_lines_are_read_once(spark, tables, capsys):
    read_claims(spark, tables).explain()
    assert capsys.readouterr().out.count("lineitem.parquet") == 1
