"""Near copies by SimHash fingerprints, paired by covering locality-sensitive hashing.

Every text gets a 64-bit fingerprint. For a radius r each bit is given a non-zero vector of r + 1
bits, and each of the 2^(r+1) - 1 non-zero vectors v makes a table: it keeps the fingerprint's
bits whose vector has an odd product with v. Two fingerprints that differ in at most r bits
leave r equations in r + 1 unknowns, so some v ignores every differing bit: the pair meets in
that table's bucket, always.

Inside a bucket no pairs are listed. A member can differ from a partner only in the bits the
table ignores, so each member of a bucket of two or more writes the values that it reaches by
flipping some of those bits: up to r // 2 on one side, up to r - r // 2 on the other. Partners
meet at a value in the middle, all that meet there are within r of each other, and a star from
the smallest of them keeps their links. A value is reached by at most the fingerprints around
it, so neither a task nor a group grows with the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from claimscope.llm.tables import free_name, tidy
from claimscope.session import materialise

BITS = 64

#: Shingles that are hashed at once.
CHUNK = 1 << 16


def fingerprint(text: str, words_per_shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text; bit i is set if it is in over half the hashes."""
    found = text.encode().lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], spaces + 1))
    ends = np.concatenate((spaces, [len(joined)]))
    n = max(1, len(found) - words_per_shingle + 1)
    starts, ends = starts[:n], ends[min(words_per_shingle, len(found)) - 1 :]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        counts += _bit_counts(np.array([xxh64_intdigest(joined[a:b], seed) for a, b in spans], "<u8"))
    return int(((counts * 2 > n) << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    sums = bits[:whole].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return sums + bits[whole:].sum(axis=0, dtype=np.int64)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row; a null text is an empty one, with fingerprint zero."""
    return _marked(docs, id_column, text_column, words_per_shingle, seed).select("doc_id", "fingerprint")


def _marked(docs: DataFrame, id_column: str, text_column: str, words_per_shingle: int, seed: int) -> DataFrame:
    """doc_id, text_hash and fingerprint of each row."""
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.array([fingerprint(x.as_py() or "", words_per_shingle, seed) for x in batch.column("text")], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(marks.view(np.int64))], ["doc_id", "text_hash", "fingerprint"])

    text = docs[text_column]
    rows = docs.select(docs[id_column].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text_hash long, fingerprint long")


def covering_masks(radius: int) -> list[int]:
    """One mask for each table: the bits that the table keeps."""
    vectors = [i % (2 ** (radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between the fingerprints of ``distinct`` that join all pairs within the radius.

    Each link is itself within the radius. Not every such pair has a row of its own: partners
    around one value are linked to the smallest of them, which keeps every connected group.
    """
    if not 1 <= radius <= 3:
        raise ValueError("the radius is 1, 2 or 3")
    masks = covering_masks(radius)
    near, far = radius // 2, radius - radius // 2
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(_signed(m)).alias("kept")) for t, m in enumerate(masks)])
    keyed = distinct.select("fingerprint", F.explode(tables).alias("table")).select(
        "fingerprint", F.col("table.t").alias("t"), F.col("fingerprint").bitwiseAND(F.col("table.kept")).alias("bucket")
    )
    shared = keyed.groupBy("t", "bucket").agg(F.count("*").alias("members")).filter("members > 1").select("t", "bucket")
    members = keyed.join(shared, ["t", "bucket"]).select("t", "fingerprint")

    flips = F.lit(None)
    for t, mask in enumerate(masks):
        free = [1 << i for i in range(BITS) if not mask >> i & 1]
        ways = [(_signed(sum(c)), k) for k in range(far + 1) for c in combinations(free, k)]
        flips = F.when(F.col("t") == t, F.array(*[F.struct(F.lit(x).cast("long").alias("by"), F.lit(k).alias("k")) for x, k in ways])).otherwise(flips)
    reached = members.select("fingerprint", F.explode(flips).alias("flip")).select(
        "fingerprint", F.col("fingerprint").bitwiseXOR(F.col("flip.by")).alias("value"), F.col("flip.k").alias("k")
    )
    meetings = reached.groupBy("value").agg(
        F.min(F.when(F.col("k") <= near, F.col("fingerprint"))).alias("a"), F.collect_set("fingerprint").alias("around")
    )
    pairs = meetings.filter(F.col("a").isNotNull() & (F.size("around") > 1)).select("a", F.explode("around").alias("b"))
    # the distance is checked once more, so that no link rests on the masks alone
    return pairs.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of ``edges``: root is the smallest node connected with it.

    Large and small stars in turn: every node links its larger neighbours, then its smaller
    ones, to the smallest. Both keep the components, and when nothing changes any more each is a
    star around its root. Every round is written to the shared folder.
    """
    now = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v").distinct())
    state = _state(now)
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = materialise(small.filter("u != v").distinct())
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)


def _state(edges: DataFrame) -> tuple[int, int | None]:
    """The number of links and an order-free digest of them."""
    digest = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), digest).first())


def near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (signed long) and component_id of each row of ``docs``.

    component_id is the smallest doc_id of all rows whose fingerprints are connected by steps of
    at most ``radius`` bits. Rows without words have fingerprint zero and are linked like any
    other. Repeated rows stay repeated; a null doc_id gets a component like any other row and
    never names one, unless all of its group are null. Other columns are left out whatever their
    names; an empty table gives an empty one.
    """
    marks = materialise(fingerprints(docs, id_column, text_column, words_per_shingle, seed))
    groups = materialise(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    rooted = _rooted(groups, radius)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    names = materialise(rooted.join(named, "root").select("fingerprint", "component_id"))
    return marks.join(names, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _rooted(groups: DataFrame, radius: int) -> DataFrame:
    """``groups`` (a row for each fingerprint) and root, the smallest fingerprint connected with the row's."""
    linked = components(links(groups.select("fingerprint"), radius)).withColumnRenamed("node", "fingerprint")
    return groups.join(linked, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))


def without_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", words_per_shingle: int = 3, radius: int = 2, seed: int = 42, one_per_id: bool = True) -> DataFrame:
    """One row of ``docs`` for each group of near copies, all columns as they are.

    It is the row with the smallest doc_id, of several texts of that id the one with the smallest
    hash; rows without doc_id stay only where their whole group has none. With ``one_per_id``
    one row stays where a doc_id would be kept for several groups, that is with different texts.
    """
    marks = _marked(docs, id_column, text_column, words_per_shingle, seed)
    # rows of one id and text are counted first: equal rows share id and hash, and one of them stays
    each = materialise(marks.groupBy("fingerprint", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")
    groups = materialise(each.groupBy("fingerprint").agg(F.min(row).alias("least")))
    kept = _rooted(groups, radius).groupBy("root").agg(F.min("least").alias("least")).select("least.*")
    if one_per_id:
        first = kept.filter("NOT unnamed").groupBy("doc_id").agg(F.min(F.struct("text_hash", "n")).alias("f")).select("doc_id", "f.*")
        kept = first.unionByName(kept.filter("unnamed").drop("unnamed"))
    kept_id, kept_hash, number = (free_name(docs, c) for c in ("kept_id", "kept_hash", "n"))
    kept = materialise(kept.select(F.col("doc_id").alias(kept_id), F.col("text_hash").alias(kept_hash), F.col("n").alias(number)))
    once, often = kept.filter(F.col(number) == 1), kept.filter(F.col(number) > 1)
    own, text_hash = docs[id_column], F.xxhash64(docs[text_column])
    single = docs.join(once, own.eqNullSafe(F.col(kept_id)) & (text_hash == F.col(kept_hash)), "left_semi")
    if often.isEmpty():
        return single
    repeated = docs.join(often, own.eqNullSafe(F.col(kept_id)) & (text_hash == F.col(kept_hash)), "left_semi")
    repeated = repeated.withColumn(kept_hash, text_hash).dropDuplicates([id_column, kept_hash]).drop(kept_hash)
    return single.unionByName(repeated)


def hex_digits(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")
