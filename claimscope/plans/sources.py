"""Source and sink queries: claims written as files and read back."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.functions.columns import joined
from claimscope.operators import history as H
from claimscope.plans.claims_sql import over_claims
from claimscope.plans.registry import Registry
from claimscope.session import scratch_path
from claimscope.sources import files as S
from claimscope.sources.tables import claims

registry = Registry()

_COLUMNS = [
    "claim_id", "patient_id", "provider_id", "date_of_service", "billed_amount", "claim_type",
    "procedure_codes", "fraud_indicator",
]
_SQL = """SELECT claim_id, patient_id, provider_id, date_of_service, billed_amount::DOUBLE AS billed_amount, claim_type,
  coalesce(array_to_string(procedure_codes, '|'), '') AS procedure_codes, fraud_indicator FROM claims"""


def _plain(rows):
    return rows.select(*_COLUMNS).withColumns(
        {
            "billed_amount": F.col("billed_amount").cast("double"),
            "procedure_codes": joined(F.col("procedure_codes")),
        }
    )


def _document_files(spark, sf_dir):
    path = scratch_path(spark)
    S.as_documents(claims(spark, sf_dir, *_COLUMNS)).write.text(path)
    return path


def _read_text(spark, path):
    """The written part files end in .txt."""
    raw = spark.read.schema(S.FILE_SCHEMA).option("columnNameOfCorruptRecord", S.CORRUPT).json(path)
    return raw.select("*", "_metadata.file_path", "_metadata.file_size")


@registry.query(over_claims(_SQL))
def claims_from_json_documents(spark, sf_dir):
    return _plain(S.unpack_claims(_read_text(spark, _document_files(spark, sf_dir))))


@registry.query(over_claims(_SQL))
def claims_from_json_lines(spark, sf_dir):
    path = scratch_path(spark)
    S.write_claims(claims(spark, sf_dir, *_COLUMNS), path, "json")
    return _plain(S.load_claims(spark, path, lines=True))


@registry.query(
    over_claims(
        """SELECT (SELECT count(*) FROM claims WHERE provider_id IS NOT NULL) AS good_claims,
        (SELECT count(*) FROM claims WHERE provider_id IS NULL) AS bad_records"""
    )
)
def bad_records_set_aside(spark, sf_dir):
    path = scratch_path(spark)
    text = F.to_json(F.struct(*_COLUMNS))
    # records without a provider are cut short, so that they cannot be read
    broken = F.when(F.col("provider_id").isNull(), F.substring(text, 1, 20)).otherwise(text)
    claims(spark, sf_dir, *_COLUMNS).select(broken.alias("value")).write.text(path)
    raw = _read_text(spark, path)
    return raw.agg(
        F.count(F.when(F.col(S.CORRUPT).isNull() & F.col("claim_id").isNotNull(), 1)).alias("good_claims"),
        F.count(S.CORRUPT).alias("bad_records"),
    )


@registry.query(over_claims(_SQL + " WHERE claim_type = 'pharmacy'"))
def claims_of_one_type(spark, sf_dir):
    path = scratch_path(spark)
    rows = claims(spark, sf_dir, *_COLUMNS)
    # one sub-folder per type, as the loader addresses them
    rows.withColumn("kind", F.col("claim_type")).write.partitionBy("kind").json(path)
    return _plain(S.load_claims(spark, f"{path}/kind=pharmacy", lines=True))


@registry.query()
def file_inventory(spark, sf_dir):
    return S.inventory_by_type(S.file_inventory(spark, sf_dir, "*.parquet")).drop("latest")


@registry.query(over_claims("SELECT count(*) AS claims_loaded, 0::BIGINT AS read_errors FROM claims"))
def load_statistics(spark, sf_dir):
    found = S.load_statistics(_read_text(spark, _document_files(spark, sf_dir)))
    return found.select("claims_loaded", "read_errors")


_TRAINING = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("billed_amount", T.DoubleType()),
        T.StructField("fraud_indicator", T.BooleanType()),
    ]
)
_TRAINING_SQL = over_claims("SELECT claim_id, billed_amount::DOUBLE AS billed_amount, fraud_indicator FROM claims")


@registry.query(_TRAINING_SQL)
def training_data_from_csv(spark, sf_dir):
    path = scratch_path(spark) + ".csv"
    S.write_claims(claims(spark, sf_dir, "claim_id", "billed_amount", "fraud_indicator"), path, "csv")
    return S.read_training(spark, path, _TRAINING)


@registry.query(_TRAINING_SQL)
def training_data_from_json(spark, sf_dir):
    path = scratch_path(spark)
    S.write_claims(claims(spark, sf_dir, "claim_id", "billed_amount", "fraud_indicator"), path, "json")
    return S.read_training(spark, path, _TRAINING)


@registry.query(over_claims(_SQL))
def claims_from_parquet(spark, sf_dir):
    path = scratch_path(spark)
    S.write_claims(claims(spark, sf_dir, *_COLUMNS), path, "parquet")
    return _plain(spark.read.parquet(path))


@registry.query(
    over_claims(
        """SELECT patient_id, count(*) AS claims, min(date_of_service) AS first_date,
        sum(billed_amount)::DOUBLE AS total_amount FROM claims GROUP BY 1"""
    )
)
def patients_from_json(spark, sf_dir):
    path = scratch_path(spark)
    pages = H.history_documents(claims(spark, sf_dir, "claim_id", "patient_id", "date_of_service", "billed_amount"))
    pages.write.json(path)
    entries = S.read_patients(spark, path).select("patient_id", F.explode("claim_sequence").alias("c"))
    return entries.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("claims"),
        F.min("c.date_of_service").alias("first_date"),
        F.sum("c.billed_amount").cast("double").alias("total_amount"),
    )
