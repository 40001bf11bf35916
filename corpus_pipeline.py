"""Preparation of a training corpus: five stages over ``documents``, each with one of the operators.

A stage takes (spark, docs, sf_dir) and returns what it keeps of docs; ``run`` writes every
stage's result and reads it again for the next one. All stages but the last return the columns
that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.llm import inverted_index, language, secrets_forest, sentencepiece_codec, simhash
from claimscope.llm.tables import small_batches
from claimscope.session import scratch_path

#: Texts whose best language has less of the score than this are in no language that was learned.
LEAST_LANGUAGE_SCORE = 0.3


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters, or far from every language learned, go."""
    small_batches(spark)
    lang, score = language.free_name(docs, "lang_pred"), language.free_name(docs, "score")
    found = language.identify(docs, language.train(docs), lang_name=lang, score_name=score)
    kept = found.filter((F.col(lang) != language.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; different texts of one id are documents of their own."""
    small_batches(spark)
    return simhash.without_copies(docs, words_per_shingle=3, radius=2, seed=42, one_per_id=False)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word passage of the benchmark."""
    small_batches(spark)
    return inverted_index.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), phrase_words=10)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by a mark."""
    small_batches(spark)
    return secrets_forest.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    small_batches(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("secrets", without_secrets),
    ("tokens", tokens),
]

#: The trained models cannot be said in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        path = scratch_path(spark)
        made = stage(spark, docs, sf_dir)
        # Parquet has no column that is only null
        made.select(*[F.col(f"`{c}`").cast("string").alias(c) if kind == "void" else F.col(f"`{c}`") for c, kind in made.dtypes]).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
