"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q (words q apart are equal) that neither
neighbour extends, long enough for the limits given. The words of a batch of texts become one
sequence of numbers, each text closed by a number of its own. Prefix doubling ranks all stretches
of 2^k words and leaves the suffix array, in which each rank is an interval; a wavelet tree over
it answers range successor queries: the next place after x where a block occurs again. Each block
of 2^k words at a multiple of 2^k asks for its occurrences in the window behind it, at distances
2^k to 2^(k+1) - 1 (the smallest blocks at every distance). Three occurrences or more form a
progression, whose step and whose borders leave at most two distances to look at. Candidates grow
both ways by the ranks, and the grown stretches give the runs.

Blocks of 8 words are enough if a run has at least 24 words and three periods: it then holds a
whole block of the level of its period, and the same block one period later.

What the rows give: a null text has no words, no runs and an empty collapsed text, and so has an
empty one; every row of a repeated id is treated as a text of its own, null ids too. Other columns
are not read. A text is one task's work, of about 40 * log2(words) bytes a word, however long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrays import NOT_SPACE, pieces, utf8
from claimscope.llm.tables import tidy

#: Bytes of text worked on at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 20

#: The smallest blocks have 2^3 words.
FIRST_LEVEL = 3

RUN = "struct<start:long,length:long,period:long>"


class WaveletTree:
    """The numbers 0 .. n - 1 in some order, as one bit vector with counts for each binary digit."""

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.zeros: list[np.ndarray] = []  # for each digit, from the highest: zeros before each place
        for digit in range(max(self.n - 1, 1).bit_length() - 1, -1, -1):
            one = (values >> digit) & 1 == 1
            before = np.zeros(self.n + 1, np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[~one], values[one]))

    def successor(self, begin: np.ndarray, end: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each query the smallest number of at least ``least`` at the places begin .. end - 1, n where there is none."""
        digits = len(self.zeros)
        b, e, smaller = begin, end, np.zeros(len(begin), np.int64)
        for level, before in enumerate(self.zeros):  # how many numbers at these places are smaller
            one = (least >> (digits - 1 - level)) & 1 == 1
            zb, ze = before[b], before[e]
            smaller += np.where(one, ze - zb, 0)
            b, e = np.where(one, before[-1] + b - zb, zb), np.where(one, before[-1] + e - ze, ze)
        smaller = np.where(least >= self.n, end - begin, smaller)
        found = np.full(len(begin), self.n, np.int64)
        some = np.flatnonzero(smaller < end - begin)
        b, e, nth, value = begin[some], end[some], smaller[some], np.zeros(len(some), np.int64)
        for before in self.zeros:  # the number of that rank
            zb, ze = before[b], before[e]
            one = nth >= ze - zb
            nth = np.where(one, nth - (ze - zb), nth)
            value = 2 * value + one
            b, e = np.where(one, before[-1] + b - zb, zb), np.where(one, before[-1] + e - ze, ze)
        found[some] = value
        return found


class Stretches:
    """Ranks of all stretches of 2^k numbers of a sequence whose last number is unique in it.

    ``ranks[k][i]`` is the first place in ``suffixes`` of a stretch equal to that at i, ``ends[k]`` at
    that rank the place after the last one.
    """

    def __init__(self, numbers: np.ndarray, levels: int) -> None:
        n = len(numbers)
        count = np.bincount(numbers)
        first = np.cumsum(count) - count
        rank = first[numbers]
        self.suffixes = np.argsort(numbers, kind="stable")
        end = np.zeros(n, np.int64)
        end[first[count > 0]] = (first + count)[count > 0]
        self.ranks, self.ends = [rank.astype(np.int32)], [end.astype(np.int32)]
        for k in range(levels):
            open_ = self.suffixes[(end[rank] - rank)[self.suffixes] > 1]  # in order of rank; the others are settled
            later = open_ + (1 << k)
            second = np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
            own = rank[open_]
            order = np.argsort(own * (n + 1) + second, kind="stable")
            open_, own, second = open_[order], own[order], second[order]
            old = np.ones(len(open_), bool)
            old[1:] = own[1:] != own[:-1]
            new = old.copy()
            new[1:] |= second[1:] != second[:-1]
            place = np.arange(len(open_))
            group = np.maximum.accumulate(np.where(old, place, 0))
            here = np.maximum.accumulate(np.where(new, place, 0))
            rank, end = rank.copy(), end.copy()
            self.suffixes[own + place - group] = open_
            rank[open_] = own + here - group
            starts = np.flatnonzero(new)
            end[rank[open_[starts]]] = rank[open_[starts]] + np.diff(np.r_[starts, len(open_)])
            self.ranks.append(rank.astype(np.int32))
            self.ends.append(end.astype(np.int32))

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers from i on equal those from j on; i < j."""
        total = np.zeros(len(i), np.int64)
        top = self.ranks[-1]
        open_ = np.arange(len(i))
        while len(open_):
            open_ = open_[top[i[open_] + total[open_]] == top[j[open_] + total[open_]]]
            total[open_] += 1 << (len(self.ranks) - 1)
        for k in range(len(self.ranks) - 2, -1, -1):
            total += (self.ranks[k][i + total] == self.ranks[k][j + total]).astype(np.int64) << k
        return total

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many numbers before i equal those before j; i < j."""
        total = np.zeros(len(i), np.int64)

        def same(k: int, at: np.ndarray | slice) -> np.ndarray:
            a, b = i[at] - total[at] - (1 << k), j[at] - total[at] - (1 << k)
            return (a >= 0) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])

        open_ = np.arange(len(i))
        while len(open_):
            open_ = open_[same(len(self.ranks) - 1, open_)]
            total[open_] += 1 << (len(self.ranks) - 1)
        for k in range(len(self.ranks) - 2, -1, -1):
            total += same(k, slice(None)).astype(np.int64) << k
        return total


def runs_of(numbers: np.ndarray, longest: int, least_length: int = 24, least_periods: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of all runs in ``numbers``, by start and period.

    ``numbers`` may hold several texts, each closed by a number that occurs once; ``longest`` is
    the length of the longest.
    """
    if least_length < 3 << FIRST_LEVEL or least_periods < 3:
        raise ValueError("blocks of 8 words find runs of at least 24 words and three periods")
    nothing = np.zeros(0, np.int64)
    if longest < least_length:
        return nothing, nothing, nothing
    levels = max(FIRST_LEVEL, (longest // least_periods).bit_length() - 1)
    stretches = Stretches(numbers, levels)
    tree = WaveletTree(stretches.suffixes)
    places, distances = [nothing], [nothing]
    n = len(numbers)
    for k in range(FIRST_LEVEL, levels + 1):
        block = 1 << k
        s = np.arange(0, n, block)
        begin = stretches.ranks[k][s].astype(np.int64)
        end = stretches.ends[k][begin].astype(np.int64)
        some = end - begin > 1
        s, begin, end = s[some], begin[some], end[some]
        if k == FIRST_LEVEL:  # short blocks: every distance at which they occur
            o = s
            while len(s):
                o = tree.successor(begin, end, o + 1)
                some = o < np.minimum(s + 2 * block, n)
                s, begin, end, o = s[some], begin[some], end[some], o[some]
                places.append(s)
                distances.append(o - s)
            continue
        found = [tree.successor(begin, end, s + block)]
        for _ in range(2):
            some = found[-1] < np.minimum(s + 2 * block, n)
            s, begin, end, found = s[some], begin[some], end[some], [o[some] for o in found]
            # one occurrence is a candidate as it is; a later one may not be there
            places.append(s)
            distances.append(found[-1] - s)
            found.append(tree.successor(begin, end, found[-1] + 1))
        some = found[-1] < np.minimum(s + 2 * block, n)
        s, (o, second, _) = s[some], [x[some] for x in found]
        step = second - o  # three occurrences within one block: the block has this period
        right, right_o = s + step + stretches.forward(s, s + step), o + step + stretches.forward(o, o + step)
        left, left_o = s - stretches.backward(s, s + step), o - stretches.backward(o, o + step)
        places += [s, s, s]
        distances += [step, right_o - right, left_o - left]
    s, q = np.concatenate(places), np.concatenate(distances)
    some = (q > 0) & (s + q < n)
    s, q = s[some], q[some]
    start = s - stretches.backward(s, s + q)
    length = s + q + stretches.forward(s, s + q) - start
    some = (length >= least_length) & (length >= least_periods * q)
    start, length, q = start[some], length[some], q[some]
    order = np.lexsort((q, length, start))
    start, length, q = start[order], length[order], q[order]
    smallest = np.ones(len(start), bool)  # multiples of a period grow to the same stretch
    smallest[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, q = start[smallest], length[smallest], q[smallest]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _of_texts(texts: pa.Array, least_length: int, least_periods: int) -> tuple[pa.Array, pa.Array, pa.Array]:
    """For each text its number of words, its runs and the text without repeated periods."""
    data, offsets = utf8(texts)
    inside = NOT_SPACE[data]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=before[1:])
    fresh = inside.copy()
    fresh[1:] &= ~inside[:-1]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    fresh[cuts] = inside[cuts]  # a text's first byte begins a word whatever ends the text before
    starts = np.flatnonzero(fresh)
    first = np.searchsorted(starts, offsets)  # number of each text's first word
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.r_[before[starts], before[-1]]), pa.py_buffer(data[inside])])
    n_words, n_texts = np.diff(first), len(texts)
    ids = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    numbers = np.zeros(len(starts) + n_texts, np.int64)
    closing = first[1:] + np.arange(n_texts)
    is_word = np.ones(len(numbers), bool)
    is_word[closing] = False
    numbers[is_word] = ids
    numbers[closing] = len(starts) + np.arange(n_texts)
    start, length, period = runs_of(numbers, int(n_words.max(initial=0)), least_length, least_periods)
    text = np.searchsorted(closing, start)
    edges = np.zeros(len(numbers) + 1, np.int32)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.flatnonzero((np.cumsum(edges[:-1]) == 0)[is_word])
    runs = pa.StructArray.from_arrays([pa.array(start - (first[:-1] + np.arange(n_texts))[text]), pa.array(length), pa.array(period)], names=["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(n_texts + 1)).astype(np.int32)), runs)
    lists = pa.LargeListArray.from_arrays(pa.array(np.searchsorted(kept, first)), words.take(pa.array(kept)))
    collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string())
    return pa.array(n_words), runs, collapsed


def periodic_runs(docs: DataFrame, least_length: int = 24, least_periods: int = 3, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, runs, collapsed): the runs of each text by start, then period.

    ``runs`` counts words from 0. ``collapsed`` has the words that remain once every run keeps only
    its first period, joined by single spaces.
    """
    given = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text", PIECE_BYTES):
                n_words, runs, collapsed = _of_texts(piece.column("text"), least_length, least_periods)
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), n_words, runs, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    id_type = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(tidy(find), f"doc_id {id_type}, n_words long, runs array<{RUN}>, collapsed string")
