"""Repeated passages by relative Lempel-Ziv parsing.

Texts are parsed greedily against reference blocks: from left to right the longest stretch that
goes on alike in the reference is a factor, words found nowhere are literals. A factor of at
least ``window`` words is a duplicate span, and the windows across a factor's boundary are looked
up one by one, so no repeated window is lost where two factors meet.

Two kinds of blocks hold all references:

* A batch of documents is a block of its own. It is parsed against itself, earlier words first,
  and only windows that are new in it are passed on. A passage that many documents share leaves
  a batch once.
* New windows are dealt to shared blocks by their anchor, the smallest hash of the word k-grams
  inside. Equal windows have equal anchors, so each meets all its equals in one block, and
  neighbouring windows mostly share an anchor, so they travel together as one phrase. Anchors
  with an outsized share of the phrases are found beforehand; their windows are dealt one by one.

The order of references is (doc_id, start): the first occurrence stays, later ones are spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrays import NOT_SPACE, Words, mix, ngrams, pieces, words
from claimscope.llm.tables import short_mark
from claimscope.session import materialise

#: Bytes of text in a batch's own block.
BLOCK_BYTES = (4 << 20) - 1

#: Words of the k-grams among which a window's anchor is chosen.
ANCHOR_WORDS = 8

#: Bytes kept of a window's hash; its anchor adds eight more.
HASH_BYTES = 6

#: Phrases that one step of a shared block looks at together.
PHRASE_ROWS = 20_000

_NO_ID = np.iinfo(np.int64).min  # a null doc_id comes first
_LOW = np.uint64((1 << (8 * HASH_BYTES)) - 1)


class Block:
    """One batch of documents in (doc_id, row) order, and its windows."""

    def __init__(self, part: pa.RecordBatch, window: int) -> None:
        ids = part.column("doc_id").fill_null(_NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.doc_id, self.mark = ids[order], part.column("mark").to_numpy()[order]
        self.words: Words = words(part.column("text").take(pa.array(order)), NOT_SPACE)
        hashes = self.words.hashes()
        k = min(ANCHOR_WORDS, window)
        last = self.words.first[self.words.text + 1]  # one past the last word of the same text
        at = np.arange(len(hashes))
        self.start = np.flatnonzero(at + window <= last)  # words at which a window begins
        full = ngrams(hashes, window)
        self.hash = full[self.start] if len(full) else np.zeros(0, np.uint64)
        grams = ngrams(hashes, k)
        self.anchor = (_sliding_min(grams, window - k + 1)[self.start] if len(full) else np.zeros(0, np.uint64)) & np.uint64((1 << 63) - 1)

    def earlier(self) -> np.ndarray:
        """For each window the number of the first equal one in the block, by (doc_id, start)."""
        text = self.words.text[self.start]
        offset = self.start - self.words.first[text]
        # rows that share a doc_id are one document: its windows go by their start
        rank = np.searchsorted(np.unique(self.doc_id), self.doc_id)[text]
        order = np.lexsort((offset, rank, self.hash))
        ordered = self.hash[order]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, bool)
        first = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(ordered) else order
        source = np.empty(len(order), np.int64)
        source[order] = first
        same = (rank[source] == rank) & (offset[source] == offset)  # rows of one doc_id at one start: neither is earlier
        return np.where(same, np.arange(len(source)), source)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of each n consecutive entries."""
    size = 1
    while size * 2 <= n and len(x) > size:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = n - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest and len(x) > rest else x


def factors(text: np.ndarray, start: np.ndarray, source_text: np.ndarray, source_start: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Greedy factors over windows that were found in a reference: (first entry, length in words).

    Entries are in (text, start) order. A factor goes on while text and reference move on
    together; where they part, the next window, which lies across the boundary, begins a factor
    of its own if it was found as well.
    """
    if not len(text):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    goes_on = (text[1:] == text[:-1]) & (start[1:] == start[:-1] + 1) & (source_text[1:] == source_text[:-1]) & (source_start[1:] == source_start[:-1] + 1)
    first = np.concatenate(([0], np.flatnonzero(~goes_on) + 1))
    return first, np.diff(np.concatenate((first, [len(text)]))) + window - 1


_SPAN = "doc_id long, mark int, start int, length int, source_id long, source_start int"
_SENT = f"key long, first_start int, hashes binary, {_SPAN}"


def _ids(values: np.ndarray) -> pa.Array:
    return pa.array(values, mask=values == _NO_ID)


def _batches(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Block]:
    """Blocks of about BLOCK_BYTES, whatever the size of the batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in pieces(batch, "text", BLOCK_BYTES // 8):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size and size + n > BLOCK_BYTES:
                yield Block(_joined(held), window)
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield Block(_joined(held), window)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _phrases(block: Block, source: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window numbers, key of each, where phrases begin) of the windows that are new in the block."""
    own = np.flatnonzero(source == np.arange(len(source)))
    anchor = block.anchor[own]
    alone = np.isin(anchor, hot)
    key = np.where(alone, mix(anchor ^ block.hash[own]), anchor)
    start = block.start[own]
    goes_on = (key[1:] == key[:-1]) & (start[1:] == start[:-1] + 1) & (block.words.text[start[1:]] == block.words.text[start[:-1]])
    return own, key, np.concatenate(([0], np.flatnonzero(~goes_on) + 1)) if len(own) else np.zeros(0, np.int64)


def _hot_anchors(rows: DataFrame, window: int, partitions: int) -> np.ndarray:
    """Anchors that may hold over 1/16 of a partition's share of all phrases.

    A batch names those with half that share of its own phrases, at most 32 for each partition;
    an anchor with the whole share overall has half of it in batches that name it. So the list
    that comes to the driver is bounded by the number of partitions.
    """
    share = 1 / (16 * max(1, partitions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _batches(batches, window):
            own, key, first = _phrases(block, block.earlier(), np.zeros(0, np.uint64))
            found, counts = np.unique(key[first], return_counts=True)
            named = counts >= max(2, share / 2 * len(first))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((found[named].view(np.int64), [-1]))), pa.array(np.concatenate((counts[named], [len(first)])))], ["anchor", "n"]
            )

    counted = rows.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("anchor") == -1, F.col("n")))
    counted = materialise(counted)
    least = max(1000.0, share / 2 * (counted.agg(total).first()[0] or 0))
    named = counted.filter((F.col("anchor") != -1) & (F.col("n") >= least)).select("anchor").collect()
    return np.array(sorted(x[0] for x in named), np.int64).view(np.uint64)


def _hash_bytes(hashes: np.ndarray, first: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES])
    offsets = np.concatenate((first, [len(hashes)])) * HASH_BYTES
    return pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _parse_own_block(window: int, hot: np.ndarray):
    """Spans inside a batch, and the phrases that the shared blocks have to look at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("key", pa.int64()), ("first_start", pa.int32()), ("hashes", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int32()), ("start", pa.int32()), ("length", pa.int32()), ("source_id", pa.int64()), ("source_start", pa.int32())])
        for block in _batches(batches, window):
            source = block.earlier()
            text = block.words.text[block.start]
            offset = (block.start - block.words.first[text]).astype(np.int32)
            found = np.flatnonzero(source != np.arange(len(source)))
            first, length = factors(text[found], offset[found], text[source[found]], offset[source[found]], window)
            at = found[first]
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [none, pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary()), _ids(block.doc_id[text[at]]), pa.array(block.mark[text[at]]), pa.array(offset[at]), pa.array(length.astype(np.int32)), _ids(block.doc_id[text[source[at]]]), pa.array(offset[source[at]])], schema=schema
            )
            own, key, first = _phrases(block, source, hot)
            at = own[first]
            nothing = pa.nulls(len(at), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[first].view(np.int64)), pa.array(offset[at]), _hash_bytes(block.hash[own], first), _ids(block.doc_id[text[at]]), pa.array(block.mark[text[at]]), nothing, nothing, pa.nulls(len(at), pa.int64()), nothing], schema=schema
            )

    return run


def _parse_shared_block(window: int):
    """Spans of the phrases of a shared block; they come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            rows += len(batch)
            keys = batch.column("key")
            if rows < PHRASE_ROWS or keys[0].as_py() == keys[-1].as_py():
                continue
            cut = int(np.searchsorted(keys.to_numpy(), keys[-1].as_py()))  # the last key may go on in the next batch
            yield from parse(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, rows = [batch.slice(cut)], len(batch) - cut
        if held:
            yield from parse(pa.Table.from_batches(held))

    def parse(phrases: pa.Table) -> Iterator[pa.RecordBatch]:
        key = phrases.column("key").to_numpy()
        begins = np.concatenate(([True], key[1:] != key[:-1]))
        alone = begins & np.concatenate((begins[1:], [True]))  # nothing to be found in a block with one phrase
        phrases = phrases.filter(pa.array(~alone)).combine_chunks()
        if not len(phrases):
            return
        key = phrases.column("key").to_numpy()
        hashes = phrases.column("hashes").combine_chunks()
        hashes = hashes.chunk(0) if isinstance(hashes, pa.ChunkedArray) else hashes
        ends = np.frombuffer(hashes.buffers()[1], np.int32)[hashes.offset : hashes.offset + len(hashes) + 1].astype(np.int64)
        data = np.frombuffer(hashes.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, HASH_BYTES)
        count = np.diff(ends) // HASH_BYTES
        wide = np.zeros((len(data), 8), np.uint8)
        wide[:, :HASH_BYTES] = data
        value = wide.view("<u8").ravel()
        row = np.repeat(np.arange(len(key)), count)
        doc = phrases.column("doc_id").fill_null(_NO_ID).to_numpy()
        mark = phrases.column("mark").to_numpy()
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        start = phrases.column("first_start").to_numpy()[row] + step
        # the reference of a window is the first equal one in the block
        order = np.lexsort((start, doc[row], value, key[row]))
        k, v = key[row][order], value[order]
        fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])))
        source = np.empty(len(order), np.int64)
        source[order] = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        later = (doc[row] != doc[row][source]) | (start != start[source])
        found = np.flatnonzero(later)
        text = np.unique(np.stack((doc[row[found]], mark[row[found]].astype(np.int64))), axis=1, return_inverse=True)[1].ravel() if len(found) else found
        by = np.lexsort((start[found], text))
        found, text = found[by], text[by]
        first, length = factors(text, start[found], doc[row][source[found]], start[source[found]], window)
        at = found[first]
        yield pa.RecordBatch.from_arrays(
            [_ids(doc[row[at]]), pa.array(mark[row[at]]), pa.array(start[at].astype(np.int32)), pa.array(length.astype(np.int32)), _ids(doc[row[source[at]]]), pa.array(start[source[at]].astype(np.int32))],
            ["doc_id", "mark", "start", "length", "source_id", "source_start"],
        )

    return run


def _marked(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """doc_id, text and a mark that tells rows of one doc_id but different texts apart."""
    text = docs[text_column]
    return docs.select(docs[id_column].cast("long").alias("doc_id"), text.alias("text"), short_mark(text).alias("mark"))


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """Factors of at least ``window`` words that also start earlier: doc_id, mark, start, length, source_id, source_start.

    Words are ``[^\\x20\\x09-\\x0D]+``; start counts them from 0. Earlier is a smaller doc_id, or a
    smaller start in the same one; a null doc_id comes first. doc_id has to be an integer. Rows
    that share a doc_id are one document for this order; mark, a hash of the text, tells them
    apart. Spans of one document may overlap.
    """
    rows = _marked(docs, id_column, text_column)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = _hot_anchors(rows, window, partitions)
    parsed = rows.mapInArrow(_parse_own_block(window, hot), _SENT)
    # literals keep their place, phrases meet by key: one shuffle for both
    shared = parsed.repartition(partitions, F.coalesce("key", F.xxhash64("doc_id", "start"))).sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = _parse_shared_block(window)
        spans = ["doc_id", "mark", "start", "length", "source_id", "source_start"]

        def split() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known = batch.column("key").is_null()
                if known.null_count or known.true_count:
                    ready.append(batch.filter(known).select(spans))
                yield batch.filter(pc.invert(known))

        ready: list[pa.RecordBatch] = []
        for out in phrases(split()):
            yield from ready
            ready.clear()
            yield out
        yield from ready

    return shared.mapInArrow(run, _SPAN)


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 20) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed and kept_text, the kept words joined by one space.

    A word goes if a window of ``window`` words that covers it starts earlier as well. Texts of
    fewer words lose nothing; null and empty texts have no words and an empty kept_text. Rows
    with equal doc_id and equal text are treated alike and both keep what neither has earlier.
    Other columns are left out whatever their names; an empty table gives an empty one.
    """
    spans = repeated_spans(docs, id_column, text_column, window)
    joined = spans.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    rows = _marked(docs, id_column, text_column)
    joined = joined.select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))
    both = rows.join(joined, rows["doc_id"].eqNullSafe(joined["d"]) & (rows["mark"] == joined["m"]), "left").select("doc_id", "text", "starts", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", BLOCK_BYTES):
                rows = [_kept(t.as_py(), s.as_py(), n.as_py()) for t, s, n in zip(part.column("text"), part.column("starts"), part.column("lengths"))]
                n, gone, kept = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def _kept(text: str | None, starts: list[int] | None, lengths: list[int] | None) -> tuple[int, int, str]:
    found = (text or "").encode().split()
    if not starts:
        return len(found), 0, b" ".join(found).decode()
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, np.array(starts), 1)
    np.add.at(change, np.array(starts) + np.array(lengths), -1)
    gone = np.cumsum(change[:-1]) > 0
    return len(found), int(gone.sum()), b" ".join(w for w, g in zip(found, gone.tolist()) if not g).decode()
