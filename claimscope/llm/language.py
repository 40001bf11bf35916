"""Language of texts by a convolutional network over bytes, trained here in numpy.

A text is cut into windows of a fixed number of bytes, the whole of it. In each window filters of
several widths run over embedded bytes, the strongest answer of each filter is kept (max
pooling), and a softmax layer names the language. A text's scores are the mean of its windows',
each weighted by the bytes it holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from claimscope.llm.arrays import pieces, utf8
from claimscope.llm.tables import free_name, tidy

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBEDDING = 8

#: Labelled texts of each language that the fit uses at most, and windows of each text.
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_TEXT = 4

#: Labelled texts of all languages together that the fit uses at most.
ROWS = 100_000

#: Windows that the network sees at once.
BATCH = 256

PIECE_BYTES = 2 << 20

#: What texts are called that have no letter.
UNDETERMINED = "und"

_ASCII_LETTERS = np.zeros(256, bool)
_ASCII_LETTERS[0x41:0x5B] = _ASCII_LETTERS[0x61:0x7B] = True


def windows(texts: pa.Array, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x size bytes, text of each, bytes of text in each); the end of a text is filled up with zeros."""
    data, offsets = utf8(texts)
    length = np.diff(offsets)
    count = -(-length // size)
    text = np.repeat(np.arange(len(length)), count)
    step = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    begin = offsets[text] + step * size
    held = np.minimum(size, offsets[text + 1] - begin)
    at = begin[:, None] + np.arange(size)
    inside = np.arange(size) < held[:, None]
    return np.where(inside, data[np.where(inside, at, 0)], 0).astype(np.uint8) if len(text) else np.zeros((0, size), np.uint8), text, held


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: list[np.ndarray]  # for each width: width x EMBEDDING x FILTERS
    filter_bias: list[np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """For each width the answer of its filters to each byte pair (or single byte) at each place."""
        found = []
        for kernel in self.filters:
            single = [(self.embedding @ k).astype(np.float32) for k in kernel]
            pairs = [(single[j][:, None, :] + single[j + 1][None, :, :]).reshape(1 << 16, -1) for j in range(0, len(single) - 1, 2)]
            found.append(pairs + ([single[-1]] if len(single) % 2 else []))
        return found

    def answers(self, batch: np.ndarray, tables: list[list[np.ndarray]]) -> Iterator[np.ndarray]:
        """For each width the filters' answers at each place: windows x places x filters."""
        pair = batch[:, :-1].astype(np.int32) * 256 + batch[:, 1:]
        for kernel, parts in zip(self.filters, tables):
            width = len(kernel)
            places = batch.shape[1] - width + 1
            total = None
            for j, table in enumerate(parts):
                index = (pair if len(table) > 256 else batch)[:, 2 * j : 2 * j + places]
                total = table[index] if total is None else np.add(total, table[index], out=total)
            yield total

    def pooled(self, batch: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        top = [np.maximum(a.max(axis=1) + b, 0) for a, b in zip(self.answers(batch, tables), self.filter_bias)]
        return np.concatenate(top, axis=1)

    def probabilities(self, batch: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        return _softmax(self.pooled(batch, tables) @ self.dense + self.dense_bias)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(samples: np.ndarray, labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Network:
    """Train a network on windows and their languages (Adam, cross entropy, languages weighted alike)."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    names = {x: i for i, x in enumerate(languages)}
    y = np.array([names[x] for x in labels], np.int64)
    net = Network(
        languages, rng.normal(0, 0.5, (256, EMBEDDING)), [rng.normal(0, 0.3, (w, EMBEDDING, FILTERS)) for w in WIDTHS], [np.zeros(FILTERS) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))), np.zeros(max(1, len(languages))),
    )
    if not len(samples):
        return net
    weight = 1 / np.bincount(y, minlength=len(languages))
    weight = weight[y] / weight[y].mean()
    params = [net.embedding, *net.filters, *net.filter_bias, net.dense, net.dense_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            x, step = samples[chosen], step + 1
            rows = np.arange(len(x))[:, None]
            tables = [[(net.embedding @ k) for k in kernel] for kernel in net.filters]
            tops, bytes_at, active = [], [], []
            for table, kernel, bias in zip(tables, net.filters, net.filter_bias):
                places = x.shape[1] - len(kernel) + 1
                answer = sum(t[x[:, j : j + places]] for j, t in enumerate(table))
                best = answer.argmax(axis=1)  # windows x filters
                top = np.take_along_axis(answer, best[:, None, :], 1)[:, 0] + bias
                tops.append(np.maximum(top, 0))
                active.append(top > 0)
                bytes_at.append([x[rows, best + j] for j in range(len(kernel))])
            pooled = np.concatenate(tops, axis=1)
            off = _softmax(pooled @ net.dense + net.dense_bias)
            off[np.arange(len(x)), y[chosen]] -= 1
            off *= weight[chosen][:, None] / len(x)
            back = off @ net.dense.T
            grads = [np.zeros_like(net.embedding)]
            kernel_grads, bias_grads = [], []
            for k, kernel in enumerate(net.filters):
                up = back[:, k * FILTERS : (k + 1) * FILTERS] * active[k]
                bias_grads.append(up.sum(axis=0))
                grad = np.empty_like(kernel)
                for j in range(len(kernel)):
                    grad[j] = np.einsum("bf,bfe->ef", up, net.embedding[bytes_at[k][j]])
                    np.add.at(grads[0], bytes_at[k][j], up[:, :, None] * kernel[j].T[None])
                kernel_grads.append(grad)
            grads += [*kernel_grads, *bias_grads, pooled.T @ off, off.sum(axis=0)]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * (1 - epoch / epochs) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> Network:
    """A network from at most ``rows_per_language`` labelled texts of each language, chosen by a hash of id and text length.

    Of each text windows at evenly spread places are used, and only these come to the driver.
    Rows without language or text are left out; without any a network with no language.
    """
    rows = docs.select(docs[id_column].cast("string").alias("id"), docs[text_column].alias("text"), docs[lang_column].cast("string").alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.filter("lang IS NOT NULL").groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit(np.zeros((0, WINDOW), np.uint8), [])
    most = min(rows_per_language, max(1, ROWS // len(counts)))
    place = F.shiftrightunsigned(F.xxhash64("id", F.lit("language")), 11).cast("double") / float(1 << 53)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, most / n))])
    chosen = rows.filter("lang IS NOT NULL AND text IS NOT NULL").filter(place < share[F.col("lang")]).select("id", "lang", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                found, text, _ = windows(part.column("text"))
                first = np.searchsorted(text, np.arange(len(part) + 1))
                spread = [np.unique(np.linspace(a, b - 1, min(WINDOWS_PER_TEXT, b - a)).astype(int)) for a, b in zip(first[:-1], first[1:]) if b > a]
                keep = np.concatenate([np.zeros(0, np.int64), *spread]).astype(np.int64)
                of = pa.array(text[keep])
                yield pa.RecordBatch.from_arrays([part.column("id").take(of), part.column("lang").take(of), pa.array([found[i].tobytes() for i in keep], pa.binary())], ["id", "lang", "bytes"])

    samples = sorted((r["id"] or "", r["lang"], bytes(r["bytes"])) for r in chosen.mapInArrow(tidy(cut), "id string, lang string, bytes binary").collect())
    return fit(np.frombuffer(b"".join(x[2] for x in samples), np.uint8).reshape(-1, WINDOW), [x[1] for x in samples])


def has_letter(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    data, offsets = utf8(texts)
    total = np.concatenate(([0], np.cumsum(_ASCII_LETTERS[data])))
    found = total[offsets[1:]] > total[offsets[:-1]]
    for i in np.flatnonzero(~found):
        found[i] = any(map(str.isalpha, texts[i].as_py() or ""))
    return found


class Labeller:
    """Applies a network to whole texts."""

    def __init__(self, net: Network) -> None:
        self.net, self.tables = net, net.tables()

    def label(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """The language of each text and its score; ``und`` with score 0 for texts without letters."""
        languages, n = self.net.languages, len(texts)
        if not languages:
            return [UNDETERMINED] * n, np.zeros(n)
        found, text, held = windows(texts)
        total = np.zeros((n, len(languages)))
        for at in range(0, len(found), BATCH):
            part = slice(at, at + BATCH)
            np.add.at(total, text[part], self.net.probabilities(found[part], self.tables) * held[part, None])
        total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-300)
        best, letters = total.argmax(axis=1), has_letter(texts)
        return [languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters)], np.where(letters, total.max(axis=1), 0.0)


def identify(docs: DataFrame, net: Network, text_column: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score (0 to 1) in two more columns.

    All columns stay; the names of the new ones must be free. Texts that are null or without a
    letter are ``und`` with score 0, as are all texts where no language was learned. Equal texts
    get equal answers; an empty table gives an empty one.
    """
    taken = {c.lower() for c in docs.columns} & {lang_name.lower(), score_name.lower()}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    at = docs.columns.index(text_column)
    schema = StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(net)
        for batch in batches:
            named = pa.RecordBatch.from_arrays(batch.columns, [str(i) for i in range(batch.num_columns)])
            for part in pieces(named, str(at), PIECE_BYTES):
                lang, score = labeller.label(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score)], [*docs_columns, lang_name, score_name])

    docs_columns = list(docs.columns)
    return docs.mapInArrow(tidy(run), schema)
