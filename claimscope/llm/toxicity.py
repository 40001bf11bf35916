"""Toxic documents by multiple-instance learning.

Only documents carry labels. Each sentence is an instance with a score of its own, logistic in
the sum of weights of its hashed word features (the word and its beginnings); a document is
toxic if any sentence is: noisy-or, 1 - prod(1 - p). The weights are trained from the document
labels through this formula, and afterwards the sentence scores say where the offence is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimscope.llm.arrays import ALNUM, mix, pieces, words
from claimscope.llm.tables import tidy
from claimscope.session import materialise

PIECE_BYTES = (2 << 20) - 1

#: Labelled documents of each class that the fit uses at most; each with all its sentences.
ROWS_PER_CLASS = 2500

FEATURE_BITS = 18
PREFIXES = (3, 4, 5, 6, 8)

_ENDS = np.isin(np.arange(256), list(b".!?\n"))


@dataclass
class Sentences:
    """The sentences of a run of texts and the different words in each."""

    features: np.ndarray  # words x features, -1 where a word is too short
    sentence: np.ndarray  # of each word
    text: np.ndarray  # of each sentence
    begin: np.ndarray  # byte in its text at which a sentence's first word begins
    end: np.ndarray
    n_texts: int

    def __len__(self) -> int:
        return len(self.text)


def sentences(texts: pa.Array) -> Sentences:
    found = words(texts, ALNUM, lower=True)
    lengths = (*PREFIXES, None)
    hashes = found.beginnings(lengths)
    mark = np.cumsum(_ENDS[found.data])[found.starts] if len(found) else np.zeros(0, np.int64)
    fresh = np.concatenate(([True], (mark[1:] != mark[:-1]) | (found.text[1:] != found.text[:-1]))) if len(found) else np.zeros(0, bool)
    first = np.flatnonzero(fresh)
    number = np.cumsum(fresh) - 1
    once = np.sort(np.unique(hashes[-1] ^ mix(number.astype(np.uint64)), return_index=True)[1])  # a word said again says nothing new
    columns = []
    for length, hashed in zip(lengths, hashes):
        slot = (mix(hashed[once] + np.uint64(length or 0)) >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        columns.append(np.where((found.ends - found.starts)[once] >= (length or 0), slot, -1))
    text = found.text[first]
    offsets = np.concatenate(([0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))))
    last = np.concatenate((first[1:], [len(found)])) - 1 if len(first) else first
    return Sentences(np.stack(columns, axis=1), number[once], text, found.starts[first] - offsets[text], found.ends[last] - offsets[text], len(texts))


@dataclass
class Model:
    """Weights are never negative: words can make a sentence offensive, and no number of others takes that back."""

    weights: np.ndarray
    bias: float

    def sentence_scores(self, s: Sentences) -> np.ndarray:
        padded = np.concatenate((self.weights, [0.0]))
        word = padded[s.features].sum(axis=1)  # -1 takes the zero at the end
        z = np.bincount(s.sentence, word, len(s)) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def noisy_or(p: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    return 1 - np.exp(np.bincount(text, np.log1p(-np.minimum(p, 1 - 1e-12)), n_texts))


#: A labelled document as the fit sees it: features of its words, the sentence of each, how many sentences.
Instance = tuple[np.ndarray, np.ndarray, int]


def instance(s: Sentences) -> Instance:
    """The sentences of a single text."""
    return s.features.astype(np.int32), s.sentence.astype(np.int32), len(s)


def _together(docs: list[Instance]) -> Sentences:
    sizes = [n for _, _, n in docs]
    before = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    nowhere = np.zeros(sum(sizes), np.int64)
    features = np.concatenate([f for f, _, _ in docs])
    return Sentences(features, np.concatenate([s + b for (_, s, _), b in zip(docs, before)]), np.repeat(np.arange(len(docs)), sizes), nowhere, nowhere, len(docs))


def fit(docs: list[Instance], labels: list[int], epochs: int = 10, batch: int = 128, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> Model:
    """Weights that make the noisy-or of the sentence scores agree with the labels (Adam, logistic loss)."""
    weights = np.zeros(1 << FEATURE_BITS)
    bias = -9.0
    if not docs:
        return Model(weights, bias)
    rng = np.random.default_rng(seed)
    y_all = np.array(labels, float)
    parts = []
    order = rng.permutation(len(docs))
    for at in range(0, len(order), batch):
        chosen = order[at : at + batch]
        parts.append((_together([docs[i] for i in chosen]), y_all[chosen]))
    share = np.clip(y_all.mean(), 0.02, 0.98)
    m, v, mb, vb, t = np.zeros_like(weights), np.zeros_like(weights), 0.0, 0.0, 0
    for epoch in range(epochs):
        for k in rng.permutation(len(parts)):
            s, y = parts[k]
            if not len(s):
                continue
            model = Model(weights, bias)
            p = model.sentence_scores(s)
            doc = np.clip(noisy_or(p, s.text, s.n_texts), 1e-9, 1 - 1e-9)
            # d loss / d z_s = p_s for a clean document, -p_s (1 - P) / P for a toxic one
            each = np.where(y == 1, -(1 - doc) / doc * 0.5 / share, 0.5 / (1 - share)) / s.n_texts
            grad_z = each[s.text] * p
            per_word = grad_z[s.sentence]
            there = s.features >= 0
            grad = np.bincount(s.features[there], np.broadcast_to(per_word[:, None], s.features.shape)[there], len(weights)) + decay * weights
            t += 1
            step = rate * (1 - epoch / epochs)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            weights = np.maximum(0.0, weights - step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6))
            gb = grad_z.sum()
            mb += 0.1 * (gb - mb)
            vb += 0.01 * (gb * gb - vb)
            bias -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-6)
    return Model(weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> Model:
    """A model from at most about ``rows_per_class`` labelled documents of each class, chosen by a hash of the id.

    The words of all sentences of a chosen text are hashed on the executors; their features come
    to the driver, 28 bytes for each different word of a sentence. A document with several labels
    counts as toxic if one of them says so. Equal texts of one id count once; if an id stands
    for so many texts that a class exceeds its rows, its texts are chosen by a hash of their own.
    Labels without document, ids that are null and null labels are left out.
    """
    marked = labels.select(labels[id_column].alias("label_id"), labels[label_column].cast("int").alias("y"))
    marked = marked.filter("label_id IS NOT NULL AND y IS NOT NULL").groupBy("label_id").agg(F.max(F.when(F.col("y") == 1, 1).otherwise(0)).alias("y"))
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = marked.filter(_part(counts, rows_per_class, "label_id"))
    text = docs[text_column]
    rows = docs.join(F.broadcast(chosen), docs[id_column] == chosen["label_id"]).filter(text.isNotNull())
    rows = rows.select(F.col("label_id").cast("string").alias("id"), "y", F.xxhash64(text).alias("mark"), text.alias("text"))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [instance(sentences(batch.column("text").slice(i, 1))) for i in range(batch.num_rows)]
            features, sentence = (pa.array([f[k].tobytes() for f in found], pa.binary()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], features, sentence, pa.array([f[2] for f in found], pa.int32())], ["id", "y", "mark", "features", "sentence", "n"])

    once = materialise(rows.mapInArrow(tidy(featurise), "id string, y int, mark long, features binary, sentence binary, n int").dropDuplicates(["id", "mark"]))
    counts = {r["y"]: r["n"] for r in once.groupBy("y").agg(F.count("*").alias("n")).collect()}
    found = sorted(once.filter(_part(counts, rows_per_class, "id", "mark")).collect(), key=lambda r: (r["id"], r["mark"]))
    read = [(np.frombuffer(r["features"], np.int32).reshape(-1, len(PREFIXES) + 1), np.frombuffer(r["sentence"], np.int32), r["n"]) for r in found]
    return fit(read, [r["y"] for r in found])


def _part(counts: dict[int, int], rows_per_class: int, *columns: str) -> Column:
    """Whether the hash of a row's columns is in the part of its class that gives about so many rows; all of a class with fewer."""
    place = F.shiftrightunsigned(F.xxhash64(*columns, F.lit("toxicity")), 11).cast("double") / float(1 << 53)
    limit = F.create_map(*[F.lit(x) for y in (0, 1) for x in (y, min(1.0, rows_per_class / max(1, counts.get(y, 0))))])
    return place < limit[F.col("y")]


def score(docs: DataFrame, model: Model, least: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score, n_sentences, offending.

    offending lists the sentences with a score of ``least`` or more: begin and end (bytes of the
    text) and score. Texts without sentences (null and empty ones too) score 0. Repeated rows
    stay repeated; other columns are left out; an empty table gives an empty one.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    weights, bias = model.weights.astype(np.float32), model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(weights, bias)
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                s = sentences(part.column("text"))
                p = own.sentence_scores(s)
                bad = np.flatnonzero(p >= least)
                cuts = pa.array(np.searchsorted(s.text[bad], np.arange(s.n_texts + 1)), pa.int32())
                each = pa.StructArray.from_arrays([pa.array(s.begin[bad]), pa.array(s.end[bad]), pa.array(p[bad].astype(float))], ["begin", "end", "score"])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(noisy_or(p, s.text, s.n_texts)), pa.array(np.bincount(s.text, minlength=s.n_texts)), pa.ListArray.from_arrays(cuts, each)],
                    ["doc_id", "score", "n_sentences", "offending"],
                )

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, score double, n_sentences long, offending array<struct<begin: long, end: long, score: double>>")
