"""Shards that all have the mixture of the sources: proportional stratified interleaving.

Rows are ordered inside their source by a seeded hash; a row's fractional rank is its place
there over the source's size. Sorted by fractional rank the sources run through each other in
proportion, so equal cuts of this order have equal mixtures, up to a row for each source.

No source and no order is held by one task. Places come in two steps: rows are dealt to ranges
of the sorted value, the ranges' counts are added up, and rows are numbered inside a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from claimscope.session import materialise

#: Rows that a range has on average, as far as 2^RANGE_BITS ranges suffice for that.
RANGE_ROWS = 20_000
RANGE_BITS = 16

#: Bits of the seeded hash.
HASH_BITS = 60


def seeded_hash(seed: int, *values: Column) -> Column:
    """The first 15 hex digits of an MD5 over seed and values, as a number."""
    said = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(v.cast("string"), F.lit("null")) for v in values])
    return F.conv(F.substring(F.md5(said), 1, HASH_BITS // 4), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", carry: bool = False) -> DataFrame:
    """Shard and slot of each row: doc_id, source, size, text_crc32, position, shard, slot.

    size is the text's UTF-8 bytes plus one, text_crc32 their unsigned CRC-32; a null text counts
    as empty. position is the row's place in the interleaved order; shards are equal cuts of it,
    so their row counts differ by one at most, and slots number a shard's rows from 0. A null
    source is a source of its own. Repeated rows are rows of their own. Rows with equal hash and
    id go by checksum and size; if those are equal too they are exchangeable. With ``carry`` the
    whole row comes along in a column ``row``; otherwise other columns are left out.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    text = F.coalesce(docs[text_column], F.lit(""))
    whole = [F.struct(*[docs[c] for c in docs.columns]).alias("row")] if carry else []
    rows = docs.select(
        docs[id_column].alias("doc_id"), docs[source_column].alias("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), seeded_hash(seed, docs[id_column]).alias("hash"), *whole,
    )
    rows = materialise(rows.withColumn("stratum", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit(""))))
    n = rows.count()
    bits = min(RANGE_BITS, max(0, (n // RANGE_ROWS).bit_length()))
    ties = ["hash", "doc_id", "text_crc32", "size"]

    rows = rows.withColumn("range", F.shiftright("hash", HASH_BITS - bits))
    counts = rows.groupBy("stratum", "range").agg(F.count("*").alias("n"))
    before = W.partitionBy("stratum").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("stratum", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("stratum")).alias("of_source"))
    inside = F.row_number().over(W.partitionBy("stratum", "range").orderBy(*ties))
    ranked = rows.withColumn("inside", inside).join(counts, ["stratum", "range"])
    rank = F.col("before") + F.col("inside")
    ranked = ranked.withColumn("fraction", (2 * rank - 1).cast("double") / (2 * F.col("of_source")).cast("double")).drop("stratum", "range", "inside", "before", "of_source")

    ranked = materialise(ranked.withColumn("range", F.floor(F.col("fraction") * (1 << bits))))
    counts = ranked.groupBy("range").agg(F.count("*").alias("n"))
    # at most 2^RANGE_BITS rows
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("range").orderBy("fraction", *ties))
    placed = ranked.withColumn("inside", inside).join(F.broadcast(counts), "range")
    placed = placed.withColumn("position", F.col("before") + F.col("inside") - 1)
    placed = placed.withColumn("shard", F.expr(f"position * {shards} div {max(1, n)}"))
    slot = F.expr(f"position - (shard * {n} + {shards - 1}) div {shards}")
    carried = ["row"] if carry else []
    return placed.select("doc_id", "source", "size", "text_crc32", "position", F.col("shard").cast("int").alias("shard"), slot.alias("slot"), *carried)


def write_shards(docs: DataFrame, path: str, shards: int, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", format: str = "parquet") -> None:
    """Write the rows of ``docs``, columns as they are, to one folder for each shard, in slot order.

    A shard is written by as many tasks as its ranges of slots need, not by one.
    """
    placed = interleave(docs, shards, seed, id_column, source_column, text_column, carry=True)
    name = next(c for c in (f"shard{'_' * k}" for k in range(99)) if c not in docs.columns)
    spread = placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    spread.select(F.col("shard").alias(name), "row.*").write.partitionBy(name).format(format).save(path)
