"""Vector documents: stable ids, upsert, normalisation, statistics and cosine search."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.session import materialise

BLOCK_QUERIES = 4096

#: Scores that a task holds at once; only the best of them for each query are kept.
_SCORES = 2_000_000


def stable_id(column: str | Column) -> Column:
    """First 64 bits of the SHA-256 of a text, as a decimal number."""
    column = F.col(column) if isinstance(column, str) else column
    first = F.substring(F.sha2(column.cast("string"), 256), 1, 16)
    return F.conv(first, 16, 10).cast("decimal(20,0)")


def upsert(current: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Rows of both tables, the latest version per key; ``max_by`` combines map-side."""
    together = current.unionByName(incoming)
    rest = [c for c in together.columns if c != key]
    picked = together.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(version, *[c for c in rest if c != version])).alias("row"))
    return picked.select(key, "row.*").select(*together.columns)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int")


def write_bucketed(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``rows`` with one folder per bucket of the key's hash; a bucket is one task's file."""
    placed = rows.withColumn("bucket", bucket_of(key, buckets))
    placed.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def upsert_into(path: str, incoming: DataFrame, key: str, version: str, batch: int, buckets: int) -> None:
    """Upsert ``incoming`` into the table of ``write_bucketed`` at ``path``, rewriting only buckets with incoming keys.

    The table has the columns of ``incoming`` and ``batch``, the number of the write that gave a
    row its present value. A row equal to the present one changes nothing, so a batch may be
    repeated. ``buckets`` belongs to the table and stays as it was first written; it is chosen so
    that a bucket fits into a task. Keys are unique after the merge, so a key of many incoming
    rows is one row of its bucket. The merged buckets are written to the shared folder first: a
    write that is cut off can be made again.
    """
    spark = incoming.sparkSession
    incoming = materialise(incoming.withColumn("batch", F.lit(batch).cast("long")))
    if incoming.isEmpty():
        return
    # at most one number per bucket
    touched = sorted(r[0] for r in incoming.select(bucket_of(key, buckets)).distinct().collect())
    current = spark.read.schema(f"{_ddl(incoming)}, bucket int").parquet(path).where(F.col("bucket").isin(touched)).drop("bucket")
    rest = [c for c in incoming.columns if c not in (key, version, "batch")]
    latest = F.max_by(F.struct(version, *rest, "batch"), F.struct(version, *rest, -F.col("batch"))).alias("row")
    merged = current.unionByName(incoming).groupBy(key).agg(latest).select(key, "row.*").select(*incoming.columns)
    write_bucketed(materialise(merged), path, key, buckets)


def _ddl(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)


def norm(column: str) -> Column:
    return F.sqrt(F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def normalised(rows: DataFrame, column: str) -> DataFrame:
    """Vectors scaled to unit length; zero vectors stay as they are."""
    size = norm(column)
    scaled = F.transform(column, lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x.cast("double")))
    return rows.withColumn("_norm", size).withColumn(column, scaled).drop("_norm")


def collection_statistics(rows: DataFrame, column: str, dimension: int) -> DataFrame:
    """Number of vectors, their dimensions, and whether they are as expected."""
    return rows.agg(
        F.count(F.lit(1)).alias("documents"),
        F.min(F.size(column)).cast("long").alias("min_dimension"),
        F.max(F.size(column)).cast("long").alias("max_dimension"),
    ).withColumn(
        "valid",
        (F.col("documents") > 0)
        & (F.col("min_dimension") == dimension)
        & (F.col("max_dimension") == dimension),
    )


def search(
    rows: DataFrame,
    queries: DataFrame,
    key: str,
    column: str,
    k: int = 10,
    threshold: float = 0.7,
    payload: str | None = None,
) -> DataFrame:
    """The ``k`` most similar rows per query with a cosine of at least ``threshold``.

    ``queries`` holds (query_id, vector[, payload]). They are searched in blocks of about
    ``BLOCK_QUERIES``; a block goes to every task, which keeps only its best ``k`` rows per
    query. Those partial lists are then ranked per query, so no group grows with the data.
    """
    return _in_blocks(queries, lambda part: _search_block(rows, part, key, column, k, threshold, payload))


def _in_blocks(queries: DataFrame, found: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``found`` finds for each block of about ``BLOCK_QUERIES`` queries."""
    blocks = max(1, -(-queries.count() // BLOCK_QUERIES))
    place = F.pmod(F.xxhash64(F.col("query_id").cast("string")), F.lit(blocks))
    return reduce(DataFrame.unionAll, [found(queries.where(place == b)) for b in range(blocks)])


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _first_rows(scores: np.ndarray, ok: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and query of the at most ``k`` best scores of each column among those that are ``ok``; of equal ones the first rows."""
    ranked = np.where(ok, -scores, np.inf).T
    row = np.argsort(ranked, axis=1, kind="stable")[:, :k]
    query = np.repeat(np.arange(len(row)), row.shape[1])
    row = row.ravel()
    good = ok[row, query]
    return row[good], query[good]


def _search_block(
    rows: DataFrame, queries: DataFrame, key: str, column: str, k: int, threshold: float, payload: str | None,
    centers: np.ndarray | None = None, probes: int = 0,
) -> DataFrame:
    wanted = ["query_id", "vector", *([payload] if payload else [])]
    found = queries.select(*wanted).collect()
    if not found:
        nothing = [F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), key]
        return rows.select(*nothing, F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    ids = np.array([r["query_id"] for r in found])
    matrix = _units(np.array([r["vector"] for r in found], dtype=np.float64))
    only = np.array([r[payload] for r in found]) if payload else None
    asks = None if centers is None else _probed(matrix, centers, probes)
    if asks is not None:
        rows = rows.where(F.col("list").isin(sorted(set(np.nonzero(asks.any(axis=0))[0].tolist()))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for batch in batches:
            batch = batch.sort_values(key, kind="stable")  # of equal scores the smaller key comes first
            vectors = _units(np.stack(batch[column].to_numpy()).astype(np.float64))
            parts = [] if kept is None else [kept]
            lists = np.zeros(len(batch), int) if asks is None else batch["list"].to_numpy()
            for number in np.unique(lists):
                own = np.nonzero(lists == number)[0]
                asking = np.arange(len(ids)) if asks is None else np.nonzero(asks[:, number])[0]
                step = max(1, _SCORES // max(len(asking), 1))
                for some in (own[at : at + step] for at in range(0, len(own), step)):
                    scores = vectors[some] @ matrix[asking].T
                    ok = scores >= threshold
                    if only is not None:
                        ok &= batch[payload].to_numpy()[some][:, None] == only[asking][None, :]
                    row, query = _first_rows(scores, ok, k)
                    parts.append(
                        pd.DataFrame({"query_id": ids[asking[query]], key: batch[key].to_numpy()[some[row]], "score": scores[row, query]})
                    )
            kept = pd.concat(parts).sort_values(["score", key], ascending=[False, True]).groupby("query_id").head(k)
        if kept is not None:
            yield kept

    query_type = queries.schema["query_id"].dataType.simpleString()
    key_type = rows.schema[key].dataType.simpleString()
    partial = rows.select(key, column, *([payload] if payload else []), *(["list"] if asks is not None else [])).mapInPandas(
        best, f"query_id {query_type}, {key} {key_type}, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _probed(queries: np.ndarray, centers: np.ndarray, probes: int) -> np.ndarray:
    """Which lists each query asks: those of the nearest centres."""
    nearest = np.argsort(-(queries @ centers.T), axis=1, kind="stable")[:, :probes]
    asks = np.zeros((len(queries), len(centers)), bool)
    asks[np.arange(len(queries))[:, None], nearest] = True
    return asks


def build_index(rows: DataFrame, path: str, key: str, column: str, lists: int = 64, sample: int = 50_000, seed: int = 1) -> None:
    """Write ``rows`` to ``path`` in lists of similar vectors, as an index for ``search_index``.

    The centres of the lists are fitted on the ``sample`` rows with the least hash of the key;
    every row goes to the list of its nearest centre. A list is written by as many tasks as its
    rows need. Rows whose vector is null or all zeros are left out: no cosine is defined for them.
    """
    lengths = rows.withColumn("_length", norm(column)).where("_length > 0").drop("_length")
    placed = lengths.withColumn("_vector", array_to_vector(F.col(column).cast("array<double>")))
    drawn = materialise(placed.select("_vector", key).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(sample).select("_vector"))
    model = KMeans(featuresCol="_vector", predictionCol="list", k=lists, distanceMeasure="cosine", seed=seed, maxIter=20).fit(drawn)
    model.write().save(f"{path}/centers")
    spread = model.transform(placed).drop("_vector").repartitionByRange("list", F.xxhash64(F.col(key).cast("string")))
    spread.write.partitionBy("list").parquet(f"{path}/rows")


def _index(spark: SparkSession, path: str) -> tuple[DataFrame, np.ndarray]:
    centers = np.array(KMeansModel.load(f"{path}/centers").clusterCenters())
    return spark.read.parquet(f"{path}/rows"), _units(centers)


def search_index(
    path: str, queries: DataFrame, key: str, column: str, k: int = 10, threshold: float = 0.7, payload: str | None = None, probes: int = 32
) -> DataFrame:
    """As ``search``, over an index and only in the ``probes`` lists whose centres are nearest to a query.

    Scores are exact. How many lists a recall needs depends on the vectors: clustered ones need few,
    those without clusters about half of 64 for 0.9. A row in a list that is not asked is missed: ``search`` stays the way to all
    of the best rows. Lists that no query of a block asks are not read.
    """
    rows, centers = _index(queries.sparkSession, path)
    return _in_blocks(queries, lambda part: _search_block(rows, part, key, column, k, threshold, payload, centers, probes))


def probed_share(path: str, queries: DataFrame, probes: int = 32) -> float:
    """The mean share of the index's rows that a query is compared with, over at most ``BLOCK_QUERIES`` queries."""
    rows, centers = _index(queries.sparkSession, path)
    sizes = np.zeros(len(centers))
    for r in rows.groupBy("list").count().collect():  # a row per list
        sizes[r["list"]] = r["count"]
    asked = [r[0] for r in queries.select("vector").limit(BLOCK_QUERIES).collect()]
    return float((_probed(_units(np.array(asked, dtype=np.float64)), centers, probes) * sizes).sum(axis=1).mean() / sizes.sum())


def centroids(rows: DataFrame, label: str, column: str) -> DataFrame:
    """Mean vector per label as search queries, averaged per position with map-side combine."""
    means = (
        rows.select(label, F.posexplode(column).alias("position", "value"))
        .groupBy(label, "position")
        .agg(F.avg(F.col("value").cast("double")).alias("mean"))
    )
    return means.groupBy(label).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "mean"))), lambda e: e["mean"]).alias("vector")
    ).select(F.col(label).alias("query_id"), "vector", label)
