"""Claims read from the star-schema tables: one claim per order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.constants import CLAIM_TYPES, DIAGNOSIS_POOL, ORDER_FLAGS, PROCEDURE_POOL
from claimscope.functions.columns import lookup
from claimscope.session import scratch_path

ORDER_COLUMNS = [
    "claim_id", "patient_id", "date_of_service", "billed_amount", "service_location",
    "time_of_service", "day_of_week", "red_flags", "submission_timestamp", "accident_date",
]
LINE_COLUMNS = [
    "provider_id", "provider_npi", "fraud_indicator", "rendering_hours", "quantity",
    "days_supply", "fill_date", "procedure_codes", "diagnosis_codes",
]
OTHER_COLUMNS = ["claim_type", "referred_to_provider", "provider_specialty", "note_id"]
ORDER_INPUT = ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_ORDER = ["l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate"]
CLAIM_COLUMNS = ORDER_COLUMNS + LINE_COLUMNS + OTHER_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _padded(column: str | Column, width: int) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.lpad(column.cast("string"), width, "0")


def _order_values(key: Column) -> dict[str, Column]:
    day = F.col("o_orderdate").cast("date")
    price = F.col("o_totalprice")
    cents = F.when(key % 25 == 0, F.floor(price / 4000) * 10000).otherwise(F.floor(price * 2.5))
    flags = F.array(*[F.when(key % every == 0, F.lit(text)) for every, text in ORDER_FLAGS.items()])
    return {
        "claim_id": F.concat(F.lit("CLM-"), F.year(day), F.lit("-"), _padded(key, 7)),
        "patient_id": F.when(key % 997 == 0, F.concat(F.lit("PAT-GHOST-"), F.col("o_custkey")))
        .otherwise(F.concat(F.lit("PAT-"), _padded("o_custkey", 6))),
        "date_of_service": day,
        "billed_amount": (cents.cast("decimal(14,0)") / 100).cast("decimal(12,2)"),
        "service_location": F.when(F.col("o_orderpriority") == "1-URGENT", "23").otherwise("11"),
        "time_of_service": F.concat(_padded(key % 24, 2), F.lit(":30")),
        "day_of_week": F.date_format(day, "EEEE"),
        "red_flags": F.array_compact(flags),
        "submission_timestamp": F.col("o_orderdate").cast("timestamp")
        + F.make_interval(hours=(key % 72).cast("int")),
        "accident_date": F.date_sub(day, (key % 500 - 5).cast("int")),
    }


def _line_values(key: Column) -> dict[str, Column]:
    supplier = F.col("l_suppkey")
    odd = F.coalesce(supplier % 50 == 7, F.lit(False))
    return {
        "provider_id": F.when(odd, F.concat(F.lit("PRV-FRAUD-"), supplier))
        .otherwise(F.concat(F.lit("PRV-"), _padded(supplier, 5))),
        "provider_npi": F.when(odd, F.concat(F.lit("9999999"), _padded(supplier % 1000, 3)))
        .otherwise((supplier + 1000000000).cast("string")),
        "fraud_indicator": ((F.col("o_totalprice") > 400000) | odd) != (key % 29 == 0),
        "rendering_hours": F.col("l_quantity") / 10,
        "quantity": (F.col("l_quantity") * 40).cast("int"),
        "days_supply": F.col("l_linenumber") * 20,
        "fill_date": F.col("l_shipdate"),
        "procedure_codes": _pool_codes(PROCEDURE_POOL, F.col("px")),
        "diagnosis_codes": _pool_codes(DIAGNOSIS_POOL, F.col("dx")),
    }


def _pool_bits(pool: list[str], index: Column) -> Column:
    """The set of pool entries met, one bit each: a fixed-size buffer per order."""
    place = (index % len(pool)).cast("int")
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place))


def _pool_codes(pool: list[str], bits: Column) -> Column:
    """The sorted codes whose bits are set; null where no line was met."""
    met = [
        F.when(F.shiftright(bits, place).bitwiseAND(1) == 1, F.lit(code))
        for code, place in sorted((code, place) for place, code in enumerate(pool))
    ]
    return F.when(bits.isNotNull(), F.array_compact(F.array(*met)))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table kept in fewer files than there are cores, dealt out to all of them.

    A table of many files is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def _code_sets() -> dict[str, Column]:
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    return {"px": _pool_bits(PROCEDURE_POOL, part), "dx": _pool_bits(DIAGNOSIS_POOL, part + supplier)}


def _line_summary(spark: SparkSession, sf_dir: str, codes: bool, first: bool, second: bool) -> DataFrame:
    """What a claim takes from the lines of its order: the code sets, the first line, the second line's supplier.

    Lines are shuffled and sorted once, as the few columns that place them; all values come from
    one aggregation of plain numbers over the sorted lines, which needs no further shuffle.
    """
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey IS NOT NULL")
    wanted = _code_sets() if codes else {}
    if first or second:
        # the date alone: of lines that differ in nothing else the earliest has the earliest date
        lines = lines.select("l_orderkey", *LINE_ORDER[:-1], F.col("l_shipdate").cast("date").alias("l_shipdate"))
        order = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
        lines = lines.withColumn("place", F.row_number().over(order))
    if first:
        wanted |= {c: F.max(F.when(F.col("place") == 1, F.col(c))) for c in ("l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")}
    if second:
        wanted["second_supplier"] = F.max(F.when(F.col("place") == 2, F.col("l_suppkey")))
    return lines.groupBy("l_orderkey").agg(*[value.alias(name) for name, value in wanted.items()])


def read_claims(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Claims with the given columns (all of them if none is named), built from the tables.

    Tables are joined while the rows are narrow: the customer before the lines, text is made last.
    """
    wanted = list(columns) or CLAIM_COLUMNS
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(*ORDER_INPUT)
    need_codes = bool({"procedure_codes", "diagnosis_codes"} & set(wanted))
    need_first = bool(
        (set(LINE_COLUMNS) - {"procedure_codes", "diagnosis_codes"}) & set(wanted)
        or "provider_specialty" in wanted
    )
    need_second = "referred_to_provider" in wanted
    if not (need_codes or need_first or need_second):
        rows = spread(rows)
    if "claim_type" in wanted:
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
        rows = rows.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").drop("c_custkey")
    if need_codes or need_first or need_second:
        lines = _line_summary(spark, sf_dir, need_codes, need_first, need_second)
        rows = rows.join(lines, key == F.col("l_orderkey"), "left").drop("l_orderkey")
    if "provider_specialty" in wanted:
        supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
        nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
        places = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
        rows = rows.join(places, F.col("l_suppkey") == F.col("s_suppkey"), "left").drop("s_suppkey")
    if "note_id" in wanted:
        documents = table(spark, sf_dir, "documents").count()
    values = {
        **_order_values(key),
        **_line_values(key),
        "claim_type": lookup(F.col("c_mktsegment"), CLAIM_TYPES, "professional"),
        "referred_to_provider": F.concat(F.lit("PRV-"), _padded("second_supplier", 5)),
        "provider_specialty": F.col("n_name"),
        **({"note_id": key % documents} if "note_id" in wanted else {}),
    }
    return rows.select(*[values[c].alias(c) for c in wanted])


_ingested: dict[tuple[str, str], str] = {}


def ingest_claims(spark: SparkSession, sf_dir: str) -> str:
    """Write the claims table once per application to the shared folder; returns its path.

    Queries then read pruned columns of it, instead of each joining and aggregating the
    line items again.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        path = scratch_path(spark)
        read_claims(spark, sf_dir).write.parquet(path)
        _ingested[key] = path
    return _ingested[key]


def claims(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The ingested claims with the given columns; ``notes`` is looked up by ``note_id``."""
    wanted = list(columns) or [*CLAIM_COLUMNS, "notes"]
    rows = spark.read.parquet(ingest_claims(spark, sf_dir))
    if "notes" in wanted:
        documents = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("notes"))
        rows = rows.join(documents, F.col("note_id") == F.col("doc_id"), "left")
    return rows.select(*wanted)
