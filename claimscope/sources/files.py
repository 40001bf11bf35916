"""Claim files: discovery, reading with bad records set aside, inventory, and writing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEGABYTE = 1024 * 1024

# fixed values: file name patterns per claim type
TYPE_GLOBS = {
    "medical": "{*medical*,*professional*}.json",
    "pharmacy": "{*pharmacy*,*drug*}.json",
    "no_fault": "{*no_fault*,*auto*}.json",
    "fraud": "*fraud*.json",
    "valid": "*valid*.json",
}

_TEXT = T.StringType()
_LIST = T.ArrayType(T.StringType())

CLAIM_FIELDS = [
    T.StructField("claim_id", _TEXT),
    T.StructField("patient_id", _TEXT),
    T.StructField("provider_id", _TEXT),
    T.StructField("provider_npi", _TEXT),
    T.StructField("date_of_service", T.DateType()),
    T.StructField("diagnosis_codes", _LIST),
    T.StructField("diagnosis_descriptions", _LIST),
    T.StructField("procedure_codes", _LIST),
    T.StructField("procedure_descriptions", _LIST),
    T.StructField("billed_amount", T.DecimalType(12, 2)),
    T.StructField("claim_type", _TEXT),
    T.StructField("service_location", _TEXT),
    T.StructField("service_location_desc", _TEXT),
    T.StructField("day_of_week", _TEXT),
    T.StructField("time_of_service", _TEXT),
    T.StructField("rendering_hours", T.DoubleType()),
    T.StructField("red_flags", _LIST),
    T.StructField("notes", _TEXT),
    T.StructField("fraud_indicator", T.BooleanType()),
    T.StructField("fraud_type", _TEXT),
    T.StructField("referred_to_provider", _TEXT),
    T.StructField("referring_provider", _TEXT),
    T.StructField("performing_provider", _TEXT),
    T.StructField("ndc_code", _TEXT),
    T.StructField("drug_name", _TEXT),
    T.StructField("quantity", T.IntegerType()),
    T.StructField("days_supply", T.IntegerType()),
    T.StructField("prescriber_npi", _TEXT),
    T.StructField("pharmacy_npi", _TEXT),
    T.StructField("fill_date", T.DateType()),
    T.StructField("accident_date", T.DateType()),
    T.StructField("vehicle_year", T.IntegerType()),
    T.StructField("vehicle_make", _TEXT),
    T.StructField("attorney_involved", T.BooleanType()),
    T.StructField("estimated_damage", T.DoubleType()),
    T.StructField("provider_specialty", _TEXT),
    T.StructField("submission_timestamp", T.TimestampType()),
]
CLAIM_SCHEMA = T.StructType(CLAIM_FIELDS)
CORRUPT = "_corrupt_record"
FILE_SCHEMA = T.StructType(
    [*CLAIM_FIELDS, T.StructField("claims", T.ArrayType(CLAIM_SCHEMA)), T.StructField(CORRUPT, _TEXT)]
)

PATIENT_SCHEMA = T.StructType(
    [
        T.StructField("patient_id", _TEXT),
        T.StructField("claim_sequence", T.ArrayType(CLAIM_SCHEMA)),
        T.StructField("red_flags", _LIST),
        T.StructField("patient_patterns", T.MapType(_TEXT, T.DoubleType())),
        T.StructField("temporal_analysis", T.MapType(_TEXT, _TEXT)),
    ]
)


def claim_glob(claim_types: list[str] | None) -> str | None:
    """One file name pattern for several claim types; none means all files."""
    if not claim_types:
        return None
    globs = [TYPE_GLOBS.get(t, f"*{t}*.json") for t in claim_types]
    inner = [part for g in globs for part in g.removesuffix(".json").strip("{}").split(",")]
    return "{" + ",".join(dict.fromkeys(inner)) + "}.json"


def read_claim_files(
    spark: SparkSession,
    path: str,
    claim_types: list[str] | None = None,
    max_file_mb: float | None = None,
    lines: bool = False,
) -> DataFrame:
    """Raw records of the claim files: bare claims and ``{"claims": [...]}`` documents alike.

    Typed patterns look at the folder itself, the default at all folders below. There is no
    size limit unless the caller sets one; ``files_above`` then lists what is left out.
    ``lines`` reads one document per line, which lets Spark split large files.
    """
    reader = (
        spark.read.schema(FILE_SCHEMA)
        .option("multiLine", not lines)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", True)
        .option("pathGlobFilter", claim_glob(claim_types) or "*.json")
        .option("recursiveFileLookup", not claim_types)
    )
    raw = reader.json(path).select("*", "_metadata.file_path", "_metadata.file_size")
    return raw if max_file_mb is None else raw.where(F.col("file_size") <= int(max_file_mb * MEGABYTE))


def files_above(spark: SparkSession, path: str, max_file_mb: float, claim_types: list[str] | None = None) -> DataFrame:
    """file_path and file_size of the claim files that a limit of ``max_file_mb`` leaves out; none is opened."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", claim_glob(claim_types) or "*.json")
        .option("recursiveFileLookup", not claim_types)
        .load(path)
    )
    return files.where(F.col("length") > int(max_file_mb * MEGABYTE)).select(
        F.col("path").alias("file_path"), F.col("length").alias("file_size")
    )


def _with_aliases(claims: DataFrame) -> DataFrame:
    """Referring and performing provider stand in where the usual columns are absent."""
    return claims.withColumns(
        {
            "provider_id": F.coalesce("provider_id", "referring_provider"),
            "referred_to_provider": F.coalesce("referred_to_provider", "performing_provider"),
        }
    ).drop("referring_provider", "performing_provider")


def _bare() -> Column:
    return F.struct(*[F.col(f.name) for f in CLAIM_FIELDS])


def unpack_claims(raw: DataFrame) -> DataFrame:
    """One row per claim record, from lists and from bare records; others give no row."""
    items = F.when(F.col("claims").isNotNull(), F.col("claims")).when(
        F.col("claim_id").isNotNull() & F.col(CORRUPT).isNull(), F.array(_bare())
    )
    return _with_aliases(raw.select("file_path", F.explode(items).alias("c")).select("file_path", "c.*"))


def load_claims(spark: SparkSession, path: str, **options) -> DataFrame:
    """Good claims of all matching files; a bad file or record does not stop the others."""
    return unpack_claims(read_claim_files(spark, path, **options)).where("claim_id IS NOT NULL")


def quarantined(raw: DataFrame) -> DataFrame:
    """Records that could not be read, with their file.

    The filter also looks at the claims, because Spark does not parse a file for the
    corrupt-record column alone.
    """
    read = F.coalesce(F.size("claims"), F.lit(0)) >= 0
    return raw.where(F.col(CORRUPT).isNotNull() & read).select("file_path", F.col(CORRUPT).alias("record"))


def load_claim_type(spark: SparkSession, path: str, claim_type: str, **options) -> DataFrame:
    """Claims of the files of one type; an unknown type is an error."""
    if claim_type not in TYPE_GLOBS:
        raise ValueError(f"Unsupported claim type: {claim_type}")
    return load_claims(spark, path, claim_types=[claim_type], **options)


def file_type(name: Column) -> Column:
    low = F.lower(name)

    def has(*words: str) -> Column:
        return low.rlike("|".join(words))

    return (
        F.when(has("medical", "professional"), "medical")
        .when(has("pharmacy", "drug"), "pharmacy")
        .when(has("no_fault", "auto"), "no_fault")
        .when(has("fraud"), "fraud")
        .when(has("valid"), "valid")
        .otherwise("unknown")
    )


def file_inventory(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Name, type, size and time of every file; the contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", True)
        .load(path)
        .select("path", "length", "modificationTime")
    )
    name = F.element_at(F.split("path", "/"), -1)
    return files.select(
        "path", name.alias("name"), file_type(name).alias("type"),
        F.round(F.col("length") / MEGABYTE, 2).alias("size_mb"),
        F.col("length").alias("bytes"),
        F.col("modificationTime").alias("modified"),
    )


def inventory_by_type(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("type").agg(
        F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"), F.max("modified").alias("latest")
    )


def load_statistics(raw: DataFrame, seconds: float | None = None) -> DataFrame:
    """Files, claims, bad records, claims per file and, given the time, per second."""
    claims = F.coalesce(F.size("claims"), F.when(F.col("claim_id").isNotNull(), 1), F.lit(0))
    found = F.when(F.col(CORRUPT).isNull(), claims).otherwise(0)
    per_file = raw.groupBy("file_path").agg(
        F.sum(found).alias("claims"), F.count(CORRUPT).alias("errors")
    )
    total = per_file.agg(
        F.count(F.lit(1)).alias("files_processed"),
        F.sum("claims").alias("claims_loaded"),
        F.sum("errors").alias("read_errors"),
        F.avg("claims").alias("avg_claims_per_file"),
    )
    if seconds:
        total = total.withColumn("claims_per_second", F.col("claims_loaded") / seconds)
    return total


def read_training(spark: SparkSession, path: str, schema: T.StructType, label: str = "fraud_indicator") -> DataFrame:
    """Training rows from JSON lines or CSV; the label column is required."""
    if label not in schema.fieldNames():
        raise ValueError(f"Target column '{label}' not found in data")
    reader = spark.read.schema(schema)
    return reader.option("header", True).option("escape", '"').csv(path) if ".csv" in path else reader.json(path)


def read_patients(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """Patient documents with their nested claim sequence."""
    return spark.read.schema(PATIENT_SCHEMA).option("multiLine", not lines).json(path)


def flat_lists(rows: DataFrame) -> DataFrame:
    """List columns as JSON text, for formats without lists; null and the empty list stay apart."""
    lists = [f.name for f in rows.schema.fields if isinstance(f.dataType, T.ArrayType)]
    return rows.withColumns({c: F.to_json(F.col(c)) for c in lists})


def write_claims(rows: DataFrame, path: str, format: str = "parquet", mode: str = "overwrite") -> None:
    """Write claims or features as JSON lines, CSV or Parquet."""
    if format not in ("json", "csv", "parquet"):
        raise ValueError(f"Unsupported format: {format}")
    writer = (flat_lists(rows) if format == "csv" else rows).write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(format).save(path)


def as_documents(claims: DataFrame, per_document: int = 500) -> DataFrame:
    """Claims packed into ``{"claims": [...]}`` documents of about ``per_document`` claims."""
    total = max(claims.count(), 1)
    buckets = (total + per_document - 1) // per_document
    bucket = F.pmod(F.xxhash64("claim_id"), F.lit(buckets))
    return (
        claims.groupBy(bucket.alias("bucket"))
        .agg(F.collect_list(F.struct(*claims.columns)).alias("claims"))
        .select(F.to_json(F.struct("claims")).alias("value"))
    )
