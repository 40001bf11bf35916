"""Benchmark decontamination by a distributed positional inverted index.

``build_index`` cuts the documents into segments of about a million words and writes, for each
segment and term, the ascending positions of the term. ``phrase_matches`` reads the postings of
the benchmark's terms and, segment by segment, intersects the lists of each phrase after taking
off each term's offset in the phrase, the rarest term first. With a slop the terms may stand a
few words away from their places (proximity matches).

The benchmark is searched in blocks of a bounded number of words, so that neither the driver nor
a task has to hold a large benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrays import ALNUM, Words, pieces, words
from claimscope.llm.tables import text_mark, tidy, without_rows
from claimscope.session import materialise

#: Words after which a segment is closed; a longer text still is in one segment.
SEGMENT_WORDS = 1_000_000

#: Bytes of text that are cut into words at once.
PIECE_BYTES = (2 << 20) - 1

#: Benchmark words that are searched in one pass over the index.
BLOCK_WORDS = 200_000

_INDEX = "segment long, doc_no int, doc_id long, mark long, start int, n_words int, term string, positions array<int>"
_ROWS = pa.schema([
    ("segment", pa.int64()), ("doc_no", pa.int32()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int32()),
    ("n_words", pa.int32()), ("term", pa.string()), ("positions", pa.list_(pa.int32())),
])


class _Segment:
    """Documents whose words are numbered through, with a gap of one between documents."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.parts: list[tuple[Words, np.ndarray]] = []
        self.docs: list[tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]] = []
        self.size = self.n_docs = 0

    def add(self, part: pa.RecordBatch) -> None:
        found = words(part.column("text"), ALNUM, lower=True)
        n_words = np.diff(found.first)
        starts = self.size + found.first[:-1] + np.arange(len(n_words))
        self.parts.append((found, self.size + np.arange(len(found)) + found.text))
        self.docs.append((part.column("doc_id"), part.column("mark"), starts, n_words))
        self.size += len(found) + len(n_words)
        self.n_docs += len(n_words)

    def rows(self) -> Iterator[pa.RecordBatch]:
        yield self._batch(
            doc_no=pa.array(np.arange(self.n_docs, dtype=np.int32)), doc_id=pa.concat_arrays([d[0] for d in self.docs]), mark=pa.concat_arrays([d[1] for d in self.docs]),
            start=pa.array(np.concatenate([d[2] for d in self.docs]).astype(np.int32)), n_words=pa.array(np.concatenate([d[3] for d in self.docs]).astype(np.int32)),
        )
        hashes = np.concatenate([w.hashes() for w, _ in self.parts])
        places = np.concatenate([p for _, p in self.parts]).astype(np.int32)
        order = np.argsort(hashes, kind="stable")  # places of a term stay ascending
        ordered = hashes[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else order
        before = np.cumsum([0] + [len(w) for w, _ in self.parts])
        terms = []
        for i, part in zip(order[first].tolist(), (np.searchsorted(before, order[first], side="right") - 1).tolist()):
            terms.append(self.parts[part][0].word(i - int(before[part])))
        offsets = pa.array(np.concatenate((first, [len(order)])), pa.int32())
        if terms:
            yield self._batch(term=pa.array(terms, pa.binary()).cast(pa.string()), positions=pa.ListArray.from_arrays(offsets, pa.array(places[order])))

    def _batch(self, **columns: pa.Array) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        columns["segment"] = pa.array(np.full(n, self.number))
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _ROWS], schema=_ROWS)


def build_index(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The written index: a row for each segment and term, and one (with a null term) for each document.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the whole text with A-Z in small letters; a null
    text has none. doc_id has to be an integer or null. Repeated rows are documents of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        segment = _Segment(number)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                segment.add(part)
                if segment.size >= segment_words:
                    yield from segment.rows()
                    number += 1
                    segment = _Segment(number)
        if segment.n_docs:
            yield from segment.rows()

    text = docs[text_column]
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), text_mark(text).alias("mark"), text.alias("text"))
    return materialise(rows.mapInArrow(tidy(run), _INDEX))


def indexed_documents(index: DataFrame) -> DataFrame:
    """segment, doc_no, doc_id, mark and n_words of each document."""
    return index.filter("term IS NULL").select("segment", "doc_no", "doc_id", "mark", F.col("n_words").cast("long").alias("n_words"))


def item_words(items: DataFrame, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id (as text), its words; items without words are left out. Rows without id keep their words, under null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found = words(part.column("text"), ALNUM, lower=True)
                spelt = pa.array([found.word(i) for i in range(len(found))], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column("item_id"), pa.ListArray.from_arrays(pa.array(found.first, pa.int32()), spelt)], ["item_id", "words"])

    rows = items.select(items[id_column].cast("string").alias("item_id"), items[text_column].alias("text"))
    return rows.mapInArrow(tidy(run), "item_id string, words array<string>").filter("size(words) > 0")


@dataclass
class _Phrases:
    """The windows of a block of items as numbers of terms; windows of one length together."""

    terms: list[str]
    windows: dict[int, np.ndarray]
    items: dict[int, list[list[str]]]  # by length: the items of each window

    @classmethod
    def of(cls, rows: list[tuple[str, list[str]]], n: int) -> _Phrases:
        number: dict[str, int] = {}
        found: dict[int, dict[tuple[int, ...], dict[str, None]]] = {}
        for item, said in rows:
            ids = [number.setdefault(w, len(number)) for w in said]
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1):
                found.setdefault(size, {}).setdefault(tuple(ids[i : i + size]), {})[item] = None
        return cls(list(number), {size: np.array(list(w)) for size, w in found.items()}, {size: [list(x) for x in w.values()] for size, w in found.items()})

    def search(self, lists: list[np.ndarray | None], slop: int) -> Iterator[tuple[int, list[str], np.ndarray]]:
        """(length, items, start positions) of each window that occurs; ``lists`` are the places of each term."""
        sizes = np.array([0 if x is None else len(x) for x in lists])
        for size, windows in self.windows.items():
            counts = sizes[windows]
            for w in np.flatnonzero(counts.min(axis=1) > 0).tolist():
                window = windows[w]
                rarest, *others = np.argsort(counts[w], kind="stable").tolist()
                starts = lists[window[rarest]] - rarest
                for j in others:
                    starts = starts[_near(lists[window[j]], starts + j, slop)]
                    if not len(starts):
                        break
                if len(starts):
                    yield size, self.items[size][w], starts


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """Which of the wanted places, give or take slop, are in the ascending list."""
    at = np.searchsorted(places, wanted - slop)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= wanted + slop)


_MATCH = "segment long, doc_no int, item_id string, length int, starts array<int>"


def phrase_matches(index: DataFrame, items: DataFrame, phrase_words: int = 10, slop: int = 0, block_words: int = BLOCK_WORDS, id_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """Where windows of the items occur in the documents: segment, doc_no, item_id, length, starts.

    A window is ``phrase_words`` consecutive words of an item, or all words of a shorter item.
    starts are word numbers in the document, from 0, ascending. With ``slop`` a term may stand up
    to so many words before or after its place in the window; places are then those of the window
    as aligned with its rarest term. Rows of one item_id are one item, as are those without.
    """
    spark = index.sparkSession
    found = materialise(item_words(items, id_column, text_column))
    total = found.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    matches = None
    for block in range(blocks):
        rows = found.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()
        phrases = _Phrases.of([tuple(r) for r in rows], phrase_words)
        terms = spark.createDataFrame(list(enumerate(phrases.terms)), "number int, term string")
        postings = index.join(F.broadcast(terms), "term", "left").filter("term IS NULL OR number IS NOT NULL")
        part = postings.select("segment", "doc_no", "start", "n_words", "number", "positions").groupBy("segment").applyInArrow(_search(phrases, slop), _MATCH)
        matches = part if matches is None else matches.unionAll(part)
    return matches


def _search(phrases: _Phrases, slop: int):
    def run(rows: pa.Table) -> pa.Table:
        of_doc = rows.column("number").is_null()
        docs = rows.filter(of_doc).sort_by("doc_no")
        begin, n_words = (docs.column(c).to_numpy().astype(np.int64) for c in ("start", "n_words"))
        lists: list[np.ndarray | None] = [None] * len(phrases.terms)
        for number, places in zip(*(rows.filter(pc.invert(of_doc)).column(c) for c in ("number", "positions"))):
            lists[number.as_py()] = places.values.to_numpy().astype(np.int64)
        found: dict[tuple[int, str, int], list[np.ndarray]] = {}
        for size, items, starts in phrases.search(lists, slop):
            doc = np.searchsorted(begin, starts, side="right") - 1
            inside = (doc >= 0) & (starts + size <= begin[doc] + n_words[doc])
            starts, doc = starts[inside], doc[inside]
            cuts = np.flatnonzero(np.diff(doc)) + 1
            for group, no in zip(np.split(starts, cuts), doc[np.concatenate(([0], cuts))].tolist() if len(doc) else ()):
                for item in items:
                    found.setdefault((no, item, size), []).append(group - begin[no])
        keys = list(found)
        segment = rows.column("segment")[0].as_py() if len(rows) else None
        return pa.table(
            {
                "segment": pa.array([segment] * len(keys), pa.int64()), "doc_no": pa.array([k[0] for k in keys], pa.int32()), "item_id": pa.array([k[1] for k in keys], pa.string()),
                "length": pa.array([k[2] for k in keys], pa.int32()), "starts": pa.array([np.unique(np.concatenate(found[k])).astype(np.int32) for k in keys], pa.list_(pa.int32())),
            }
        )

    return run


def contamination(docs: DataFrame, items: DataFrame, phrase_words: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, mark, n_words, n_hit, n_items, items.

    n_hit counts words inside any occurrence of a window of any item; items are the ids, as text
    and sorted, of the items with occurring windows. Items without id hit as others do; they
    count as one item, which has no entry in items. Null and empty texts have no words; other
    columns are left out whatever their names; with no items nothing is hit.
    """
    index = build_index(docs, id_column, text_column)
    matches = phrase_matches(index, items, phrase_words)
    spans = F.transform("starts", lambda s: F.struct(s.alias("s"), (s + F.col("length")).alias("e")))
    joined = matches.groupBy("segment", "doc_no").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("long")).alias("nameless"), F.sort_array(F.flatten(F.collect_list(spans))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["end"], x["s"]))).alias("n")),
    )["n"]
    hits = joined.select("segment", "doc_no", "items", "nameless", covered.alias("n_hit"))
    return indexed_documents(index).join(hits, ["segment", "doc_no"], "left").select(
        "doc_id", "mark", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items") + F.col("nameless"), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, phrase_words: int = 10, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs``, columns as they are, in which no window of an item occurs."""
    hit = contamination(docs, items, phrase_words, id_column, text_column).filter("n_hit > 0")
    return without_rows(docs, hit, id_column, text_column)
