"""Texts of an Arrow batch as byte arrays, their words as spans and 64-bit hashes, all without a loop per word."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# fixed values: odd multipliers of the polynomial hashes and of the finaliser
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASE = 0xD6E8FEB86659FD93
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

#: Word bytes of ``[^\x20\x09-\x0D]+``.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``: digits, small letters, everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Bytes, and words, that are hashed at once: the tables of powers stay small, whatever the text.
HASHED_BYTES = 1 << 18
HASHED_WORDS = 1 << 16

#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def pieces(batch: pa.RecordBatch, column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of ``batch`` with at most ``limit`` bytes in ``column``; a longer text is a part of its own."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    begin, size = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if size and size + n > limit:
            yield batch.slice(begin, i - begin)
            begin, size = i, 0
        size += n
    if begin < len(lengths):
        yield batch.slice(begin)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array and the n + 1 offsets of the texts in it; null is empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of a run of texts: ``data[starts[i]:ends[i]]`` is word i, in text ``text[i]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray  # n texts + 1: number of the first word of each text

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return self.beginnings((None,))[0]

    def beginnings(self, lengths: tuple[int | None, ...]) -> list[np.ndarray]:
        """For each length a 64-bit hash of each word's first bytes; None takes the whole word."""
        found = [np.empty(len(self), np.uint64) for _ in lengths]
        for first, last in self._runs():
            begin = int(self.starts[first])
            data = self.data[begin : self.ends[last - 1]]
            starts, whole = self.starts[first:last] - begin, self.ends[first:last] - begin
            powers, inverse = _powers(_BYTE_BASE, len(data) + 1)
            total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=total[1:])
            for hashes, length in zip(found, lengths):
                ends = whole if length is None else np.minimum(starts + length, whole)
                hashes[first:last] = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        return found

    def _runs(self) -> Iterator[tuple[int, int]]:
        """Words first .. last - 1 that lie in about HASHED_BYTES; the hashes do not depend on where a run begins."""
        first = 0
        while first < len(self):
            last = max(first + 1, int(np.searchsorted(self.ends, self.starts[first] + HASHED_BYTES, side="right")))
            yield first, last
            first = last

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def words(texts: pa.Array, is_word: np.ndarray, lower: bool = False) -> Words:
    data, offsets = utf8(texts)
    if lower:
        data = LOWER[data]
    inside = is_word[data]
    edge = np.zeros(len(data) + 1, bool)  # True where a text begins
    edge[offsets] = True
    starts = np.flatnonzero(inside & ~(np.concatenate(([False], inside[:-1])) & ~edge[:-1])) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(inside & ~(np.concatenate((inside[1:], [False])) & ~edge[1:])) + 1 if len(data) else starts
    return Words(data, starts, ends, np.searchsorted(offsets, starts, side="right") - 1, np.searchsorted(starts, offsets))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive hashes; entry i covers i .. i + n - 1."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, np.uint64)
    found = np.empty(size - n + 1, np.uint64)
    for at in range(0, len(found), HASHED_WORDS):
        part = hashes[at : at + HASHED_WORDS + n - 1]
        powers, inverse = _powers(_WORD_BASE, len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * powers[: len(part)], out=total[1:])
        found[at : at + HASHED_WORDS] = mix((total[n:] - total[:-n]) * inverse[: len(part) - n + 1])
    return found


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(31))


_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of an odd base modulo 2^64, and of its inverse."""
    have = _TABLES.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        have = tuple(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 19:
            _TABLES[base] = have
    return have
