"""Unions of the sketches of linked providers, block by block of links.

Spark's sketches (DataSketches, eight bits a register) keep a few hashes as they are, later registers. Here
registers are united as matrices; what comes out are sketches that Spark reads again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.operators.blocks import MOST_BITS, SIDE, Links, _matrix, _panel, _rows_of, _tasks
from claimscope.session import materialise

#: Kinds of a sketch: a list of hashes, a table of hashes (0 where it is empty), registers.
_LIST, _TABLE, _REGISTERS = 0, 1, 2


def hashes(sketch: bytes) -> np.ndarray | None:
    """The hashes of a small sketch; None of one that has registers."""
    kind = sketch[7] & 3
    if kind == _REGISTERS:
        return None
    found = np.frombuffer(sketch, np.uint32, offset=8 if kind == _LIST else 12)
    return found[found != 0]


def registers(sketch: bytes, precision: int) -> np.ndarray:
    small = hashes(sketch)
    if small is None:
        return np.frombuffer(sketch, np.uint8, offset=40)
    made = np.zeros(1 << precision, np.uint8)
    np.maximum.at(made, small & ((1 << precision) - 1), (small >> 26).astype(np.uint8))
    return made


def sketch_of_registers(values: np.ndarray, precision: int) -> bytes:
    """A sketch as Spark makes it of a union."""
    powers, low = 2.0 ** -values.astype(np.float64), values < 32
    head = struct.pack("<dddii", 0.0, powers[low].sum(), powers[~low].sum(), int((values == 0).sum()), 0)
    return bytes([10, 1, 7, precision, 0, 16, 0, 10]) + head + values.tobytes()


def sketches_of_hashes(found: np.ndarray, precision: int) -> list[bytes]:
    """Sketches of seven hashes each; all of them united hold ``found``."""
    made = []
    for at in range(0, len(found), 7):
        part = found[at : at + 7]
        made.append(bytes([2, 1, 7, precision, 3, 0, len(part), 8]) + np.pad(part, (0, 8 - len(part))).astype("<u4").tobytes())
    return made


def united_neighbours(links: Links, sent: DataFrame, precision: int) -> DataFrame:
    """(place, met): the union of the sketches ``sent`` (block, spot, sketch) of a provider's neighbours, of those that have any.

    ``met`` is a list of sketches to be united: one with registers, or small ones while there are few hashes.
    A sketch is sent once a panel of blocks; a task keeps the registers of one panel.
    """
    side = _panel(links.nodes, MOST_BITS)
    # Spark turns to registers beyond this many hashes
    few = 7 if precision < 8 else 3 << precision - 5

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = source = total = None
        waiting: dict[int, list[np.ndarray] | None] = {}
        lengths: dict[int, int] = {}
        for q, i, kind, at, data in _rows_of(batches, "q", "i", "kind", "at", "data"):
            if panel != q:
                if panel is not None:
                    yield from ended(panel, total, waiting)
                panel, source, total, waiting, lengths = q, None, np.zeros((side * SIDE, 1 << precision), np.uint8), {}, {}
            if kind == 0:
                if source != i:
                    source, values, known, small = i, np.zeros((SIDE, 1 << precision), np.uint8), np.zeros(SIDE, bool), {}
                values[at], known[at], small[at] = registers(data, precision), True, hashes(data)
                continue
            if source != i:
                continue
            large = np.array([small.get(spot, ()) is None for spot in range(SIDE)])
            sizes = np.array([0 if small.get(spot) is None else len(small[spot]) for spot in range(SIDE)])
            spots, members = np.nonzero((_matrix(zlib.decompress(data)).astype(bool) & known[:, None]).T)
            some, starts = np.unique(spots, return_index=True)
            for spot, near in zip(some.tolist(), np.split(members, starts[1:])):
                to = at % side * SIDE + spot
                np.maximum(total[to], np.maximum.reduce(values[near], axis=0), out=total[to])
                lists = waiting.setdefault(to, [])
                if lists is None:
                    continue
                if large[near].any():
                    waiting[to] = None
                    continue
                lists += [small[m] for m in near.tolist()]
                lengths[to] = lengths.get(to, 0) + int(sizes[near].sum())
                if lengths[to] > 2 * few:
                    together = np.unique(np.concatenate(lists))
                    waiting[to], lengths[to] = None if len(together) > few else [together], len(together)
        if panel is not None:
            yield from ended(panel, total, waiting)

    def ended(panel: int, total: np.ndarray, waiting: dict[int, list[np.ndarray] | None]) -> Iterator[pa.RecordBatch]:
        for to, lists in waiting.items():
            together = None if lists is None else np.unique(np.concatenate(lists))
            if together is None or len(together) > few:
                met = [sketch_of_registers(total[to], precision)]
            else:
                met = sketches_of_hashes(together, precision)
            yield pa.RecordBatch.from_arrays([pa.array([panel * side * SIDE + to], pa.int64()), pa.array([met], pa.list_(pa.binary()))], ["place", "met"])

    panel = F.floor(F.col("j") / side).cast("int")
    around = links.blocks.select("i", panel.alias("q")).distinct()
    own = sent.join(F.broadcast(around), F.col("block") == F.col("i")).select("q", "i", F.lit(0).alias("kind"), F.col("spot").alias("at"), F.col("sketch").alias("data"))
    needed = links.blocks.join(F.broadcast(sent.select(F.col("block").alias("i")).distinct()), "i", "left_semi")
    rows = own.unionByName(needed.select(panel.alias("q"), "i", F.lit(1).alias("kind"), F.col("j").alias("at"), F.col("packed").alias("data")))
    dealt = rows.repartition(_tasks(rows), "q").sortWithinPartitions("q", "i", "kind", "at")
    return materialise(dealt.mapInArrow(unite, "place long, met array<binary>"))
