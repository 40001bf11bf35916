"""Ordered operations that stay distributed when one key holds much of the data.

A plain window sorts a whole key inside one task. The helpers here first measure the
largest key; when it is too big they number rows chunk by chunk over a range
partitioning, so that no task ever sees more than one chunk. Global orders (ranks,
running totals, quantiles) never use an unpartitioned window over the rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimscope.session import materialise

GROUP_LIMIT = 1_000_000
BINS = 1024


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest key; one partial aggregation over the key columns."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def ordered_chunks(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition by ``order`` and keep the partition number as ``_chunk``.

    The rows are written out: the chunk numbers are used twice, and sampling for the
    range bounds must not run again in between.
    """
    return materialise(df.repartitionByRange(*order).withColumn("_chunk", F.spark_partition_id()))


def running_total(
    df: DataFrame, by: Sequence[str], order: Sequence[str], weight: str, out: str
) -> DataFrame:
    """Inclusive running sum of ``weight`` in ``order`` within ``by`` (none: whole table)."""
    return running_totals(df, by, order, {weight: out})


def running_totals(df: DataFrame, by: Sequence[str], order: Sequence[str], weights: dict[str, str]) -> DataFrame:
    """Inclusive running sums, weight -> name of its sum, in ``order`` within ``by`` (none: whole table)."""
    by = list(by)
    chunks = ordered_chunks(df, [*by, *order])
    totals = chunks.groupBy(*by, "_chunk").agg(*[F.sum(w).alias(f"_total_{i}") for i, w in enumerate(weights)])
    earlier = Window.partitionBy(*by, F.lit(0)).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = [f"_before_{i}" for i in range(len(weights))]
    offsets = totals.select(
        *by, "_chunk", *[F.coalesce(F.sum(f"_total_{i}").over(earlier), F.lit(0)).alias(b) for i, b in enumerate(before)]
    )
    inside = (
        Window.partitionBy(*by, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    # a null key has its offsets as any other
    names = {c: f"_by_{i}" for i, c in enumerate([*by, "_chunk"])}
    offsets = offsets.withColumnsRenamed(names)
    same = [chunks[c].eqNullSafe(offsets[name]) for c, name in names.items()]
    return (
        chunks.join(offsets, reduce(Column.__and__, same))
        .withColumns({out: F.col(b) + F.sum(w).over(inside) for (w, out), b in zip(weights.items(), before)})
        .drop(*before, "_chunk", *names.values())
    )


def with_sequence(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, limit: int = GROUP_LIMIT
) -> DataFrame:
    """Number the rows of each key from 1 in ``order``; ``order`` must be total; null is a key too."""
    keys, order = list(keys), list(order)
    if largest_group(df, keys) <= limit:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, rank.cast("long"))
    return running_total(df.withColumn("_one", F.lit(1)), keys, order, "_one", out).drop("_one")


def over_recent(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows: int,
    columns: Callable[[Window], dict[str, Column]],
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Add columns computed over the latest ``rows`` rows of each key, current row included.

    Keys above ``limit`` are cut into blocks of ``limit`` rows; the last ``rows - 1`` rows
    of a block are also sent to the next one, so every frame is complete.
    """
    keys, order = list(keys), list(order)
    if largest_group(df, keys) <= limit:
        frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
        return df.withColumns(columns(frame))
    block_size = max(limit, rows)
    home = F.floor((F.col("_seq") - 1) / block_size)
    overlaps = (F.col("_seq") - 1) % block_size >= block_size - (rows - 1)
    spread = with_sequence(df, keys, order, "_seq", limit).withColumn(
        "_block", F.explode(F.array_compact(F.array(home, F.when(overlaps, home + 1))))
    )
    frame = Window.partitionBy(*keys, "_block").orderBy("_seq").rowsBetween(-(rows - 1), 0)
    return spread.withColumns(columns(frame)).where(F.col("_block") == home).drop("_block", "_seq")


def with_average_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentile rank with ties averaged, over the table or within ``by``.

    Ranks come from counts per distinct value, so a value shared by very many rows
    costs one row.
    """
    by = list(by)
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running_total(counts, by, [value], "_n", "_upto")
    if by:
        sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"))
        ranked = ranked.join(sizes, by)
        size = F.col("_size")
    else:
        size = F.lit(df.count())
    share = (F.col("_upto") - (F.col("_n") - 1) / 2) / size
    return df.join(ranked.select(*by, value, share.alias(out)), [*by, value], "left")


def with_sorted_code(df: DataFrame, column: str, out: str) -> DataFrame:
    """Code each value by its place (from 0) among the sorted distinct values."""
    distinct = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = running_total(distinct.withColumn("_one", F.lit(1)), [], [column], "_one", "_place")
    return df.join(coded.select(column, (F.col("_place") - 1).alias(out)), column, "left")


def _bin_counts(spans: list[tuple[str, float, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows, least and greatest value of each bin of (column, lo, hi), one row a bin and task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(spans), BINS), np.int64)
        least, most = np.full(n.shape, np.inf), np.full(n.shape, -np.inf)
        for batch in batches:
            for i, (c, lo, hi) in enumerate(spans):
                values = batch.column(c).to_numpy(zero_copy_only=False)
                values = values[(values >= lo) & (values <= hi)]
                with np.errstate(over="ignore", invalid="ignore"):
                    place = np.nan_to_num((values - lo) / (hi - lo) * BINS)
                place = np.minimum(place, BINS - 1).astype(np.int64)
                n[i] += np.bincount(place, minlength=BINS)
                np.minimum.at(least[i], place, values)
                np.maximum.at(most[i], place, values)
        span, place = np.nonzero(n)
        found = [pa.array(span, pa.int32()), pa.array(place, pa.int32()), pa.array(n[span, place]), pa.array(least[span, place]), pa.array(most[span, place])]
        yield pa.RecordBatch.from_arrays(found, ["span", "bin", "n", "lo", "hi"])

    return count


def quantiles(df: DataFrame, wanted: dict[str, Sequence[float]]) -> dict[str, dict[float, float]]:
    """Exact linearly interpolated quantiles of numeric columns; NaN counts as null.

    Each pass counts rows per bin between the bounds that still enclose a wanted rank and
    keeps the bin holding it; at most columns x ranks x BINS counts reach the driver.
    """
    df = df.select(*[F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in wanted])
    finite = {c: F.when(F.abs(F.col(c)) != float("inf"), F.col(c)) for c in wanted}
    summary = df.agg(
        *[F.count(c).alias(f"{c}_n") for c in wanted],
        *[F.count(F.when(F.col(c) == -float("inf"), 1)).alias(f"{c}_lowest") for c in wanted],
        *[F.count(finite[c]).alias(f"{c}_finite") for c in wanted],
        *[f(finite[c]).alias(f"{c}_{name}") for c in wanted for name, f in (("lo", F.min), ("hi", F.max))],
    ).first()
    ranks, found = {}, {}
    for c, probs in wanted.items():
        last, lowest = summary[f"{c}_n"] - 1, summary[f"{c}_lowest"]
        for p in probs:
            if last >= 0:
                low = min(math.floor(last * p + 1e-9), last)
                for rank in (low, min(low + 1, last)):
                    if rank < lowest:
                        found[c, rank] = -float("inf")
                    elif rank >= lowest + summary[f"{c}_finite"]:
                        found[c, rank] = float("inf")
                    else:
                        ranks[c, rank] = (summary[f"{c}_lo"], summary[f"{c}_hi"], lowest)
    while ranks:
        before = dict(ranks)
        for key, (lo, hi, _) in list(ranks.items()):
            if lo == hi:
                found[key] = lo
                del ranks[key]
        if not ranks:
            break
        spans = sorted({(c, lo, hi) for (c, _), (lo, hi, _) in ranks.items()})
        counted = (
            df.mapInArrow(_bin_counts(spans), "span int, bin int, n long, lo double, hi double")
            .groupBy("span", "bin")
            .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
            .collect()
        )
        by_span: dict[int, list] = {}
        for row in sorted(counted, key=lambda r: (r["span"], r["bin"])):
            by_span.setdefault(row["span"], []).append(row)
        for (c, rank), (lo, hi, below) in list(ranks.items()):
            for row in by_span[spans.index((c, lo, hi))]:
                if rank < below + row["n"]:
                    ranks[c, rank] = (row["lo"], row["hi"], below)
                    break
                below += row["n"]
        if ranks == before:
            raise ValueError(f"values too far apart to be told apart by bins: {sorted(ranks)}")
    result: dict[str, dict[float, float]] = {}
    for c, probs in wanted.items():
        last = summary[f"{c}_n"] - 1
        result[c] = {}
        for p in probs:
            if last < 0:
                result[c][p] = None
                continue
            low = min(math.floor(last * p + 1e-9), last)
            a, b = found[c, low], found[c, min(low + 1, last)]
            weight = max(last * p - low, 0.0)
            result[c][p] = a if a == b or weight == 0.0 else a + (b - a) * weight
    return result
