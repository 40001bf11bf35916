"""Where intermediate tables go when a job has to cut its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of the session; a private one only on a local master."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="claimscope-"))
        folder = context.getCheckpointDir()
    return folder


def scratch_path(spark: SparkSession) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{checkpoint_folder(spark)}/table-{uuid.uuid4().hex}"


def materialise(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder, compressed by ``codec`` if given, and go on from the written columns."""
    path = scratch_path(df.sparkSession)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)
