"""Small helpers on DataFrames for the operators of this folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimscope.session import materialise

#: Rows of a few short columns that are broadcast at most; a larger side is joined by a shuffle.
BROADCAST_ROWS = 100_000


# fixed values: the settings' names, and the most that one Arrow batch of texts shall hold
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": (10_000, 2_000), "spark.sql.execution.arrow.maxBytesPerBatch": (64 << 20, 8 << 20)}


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small Arrow batches, so that buffers on both sides stay small; what a user has set stays."""
    for name, (default, most) in _BATCHES.items():
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or int(now) == default:
            spark.conf.set(name, str(most))


def tidy(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on the batches of a task, giving freed memory back to the system: Spark keeps its Python workers for later tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(work(batches), 1):
            yield batch
            if i % 8 == 0:
                _give_back()
        _give_back()

    return run


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim:
        trim(0)


def text_mark(text: Column) -> Column:
    """A hash of 64 bits of a text, to tell rows apart that share an id or have none."""
    return F.xxhash64(text)


def short_mark(text: Column) -> Column:
    """31 bits of ``text_mark``: for a few texts of one id only."""
    return text_mark(text).bitwiseAND((1 << 31) - 1).cast("int")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_side(df: DataFrame) -> DataFrame:
    """``df`` written once, to be broadcast if it was counted to be small."""
    df = materialise(df)
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without_rows(docs: DataFrame, rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` without the rows named by (doc_id, mark) in ``rows``; columns and repeated rows as they are."""
    gone_id, gone_mark = free_name(docs, "gone_id"), free_name(docs, "gone_mark")
    gone = small_side(rows.select(F.col("doc_id").alias(gone_id), F.col("mark").alias(gone_mark)).distinct())
    same = docs[id_column].eqNullSafe(F.col(gone_id)) & (text_mark(docs[text_column]) == F.col(gone_mark))
    return docs.join(gone, same, "left_anti")
