"""Quality rules from a tokeniser's fertility.

A public vocabulary measures each text: characters per token, the share of tokens that are
bytes of characters it lacks, and the entropy of the text's tokens; two others give their
characters per token. Text in a language the vocabularies know gives figures in a narrow band;
noise, encoding damage and endless repetition fall outside. The bands come from the quartiles of
all texts of a language (or of a script, where no language is given) and a length class that pass
the plain rules.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from claimscope.llm.arrays import NOT_SPACE, mix, ngrams, pieces, utf8, words
from claimscope.llm.digest_cache import PieceCounter, Pieces, pre_tokens
from claimscope.llm.sentencepiece_codec import MODEL, codec, read_model
from claimscope.llm.tables import small_side, tidy
from claimscope.session import materialise

PIECE_BYTES = (2 << 20) - 1

#: Width of the bands: quartiles, and so many times their distance beyond them.
REACH = 3.0

#: The quartiles' distance counts as at least this part of the median (or of 1 for shares).
LEAST_SPREAD = 0.01

#: A length class (tokens between two powers of two) has bands of its own from so many texts on.
LEAST_TEXTS = 20

#: The bands of all lengths, for thinner classes, are for texts of so many tokens; their width grows as a mean's error does where a text has fewer.
BAND_TOKENS = 2000

#: Other public vocabularies, by the name of their measure.
OTHERS = {"chars_per_byte_token": "/opt/tokenizers/byte_bpe_50k.json", "chars_per_word_token": "/opt/tokenizers/word_bpe_49k.json"}

_SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_LEADS = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a character

SCRIPTS = ["none", "latin", "greek", "cyrillic", "hebrew", "arabic", "indic", "kana", "han", "hangul", "other"]


def _script_of_lead() -> np.ndarray:
    """The script (by number) that a character's first UTF-8 byte stands for; digits and signs are none."""
    table = np.zeros(256, np.int64)
    for low, high, name in (
        (0x41, 0x5A, "latin"), (0x61, 0x7A, "latin"), (0xC3, 0xC9, "latin"), (0xCE, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"),
        (0xD6, 0xD7, "hebrew"), (0xD8, 0xDB, "arabic"), (0xE0, 0xE0, "indic"), (0xE3, 0xE3, "kana"), (0xE4, 0xE9, "han"), (0xEA, 0xED, "hangul"), (0xF0, 0xF4, "other"),
    ):
        table[low : high + 1] = SCRIPTS.index(name)
    return table


_SCRIPT = _script_of_lead()
_MEASURES = ["chars_per_token", "byte_share", "entropy", *OTHERS]
_SCHEMA = (
    "doc_id {kind}, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, " + ", ".join(f"{m} double" for m in _MEASURES)
)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(flags)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeated_words(found, n: int = 5) -> np.ndarray:
    """For each text the words inside n-word windows that the text has twice or more."""
    at = np.arange(len(found))
    start = np.flatnonzero(at + n <= found.first[found.text + 1]) if len(found) else at
    if not len(start):
        return np.zeros(len(found.first) - 1, np.int64)
    grams = ngrams(found.hashes(), n)[start] ^ mix(found.text[start].astype(np.uint64) + np.uint64(1))
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(order), bool)
    again[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
    change = np.zeros(len(found) + 1, np.int64)
    np.add.at(change, start[again], 1)
    np.add.at(change, start[again] + n, -1)
    return _per_text(np.cumsum(change[:-1]) > 0, found.first)


def _duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def _entropy(ids: np.ndarray) -> float:
    if not len(ids):
        return 0.0
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    return float(-(share * np.log2(share)).sum())


def measures(docs: DataFrame, model_path: str = MODEL, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """Counts and token figures of each row; see ``quality`` for the columns."""
    message = read_model(model_path)
    others = [Path(path).read_text() for path in OTHERS.values()]  # read here, as workers have no files
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(message, checked=False)
        vocabularies = [PieceCounter(Tokenizer.from_str(x), cuts_at_spaces=True, split=pre_tokens(json.loads(x))) for x in others]
        ascii_byte = np.array([k == 6 and int(p[3:5], 16) < 128 for p, _, k in own.model.pieces])
        fallback = own.is_byte & ~ascii_byte
        own.forget()
        for batch in batches:
            for part in pieces(batch, "text", PIECE_BYTES):
                column = part.column("text")
                found = words(column, NOT_SPACE)
                data, offsets = utf8(column)
                n_texts = len(column)
                doc = np.searchsorted(offsets, np.flatnonzero(_LEADS[data]), side="right") - 1
                scripts = np.bincount(doc * len(SCRIPTS) + _SCRIPT[data[_LEADS[data]]], minlength=n_texts * len(SCRIPTS)).reshape(n_texts, -1)
                scripts[:, 0] = 0
                texts = [x or "" for x in column.to_pylist()]
                ids = own.encode(texts)
                found_pieces = Pieces(column.fill_null(""))
                n_tokens = np.fromiter(map(len, ids), np.int64, n_texts)
                chars = _per_text(_LEADS[data], offsets)
                byte_share = np.array([fallback[x].mean() if len(x) else 0.0 for x in ids])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("lang"), pa.array([SCRIPTS[i] for i in scripts.argmax(axis=1)]),
                        pa.array(np.diff(found.first)), pa.array(_per_text(_LEADS[data] & NOT_SPACE[data], offsets)), pa.array(_per_text(_SYMBOLS[data], offsets)),
                        pa.array([_duplicate_lines(x.encode()) if "\n" in x else 0 for x in texts], pa.int64()), pa.array(_repeated_words(found)),
                        pa.array(n_tokens), pa.array(chars / np.maximum(n_tokens, 1)), pa.array(byte_share, pa.float64()), pa.array([_entropy(x) for x in ids], pa.float64()),
                        *[pa.array(chars / np.maximum(v.of_pieces(found_pieces).to_numpy(), 1)) for v in vocabularies],
                    ],
                    ["doc_id", "lang", "script", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens", *_MEASURES],
                )

    lang = F.lit(None).cast("string") if lang_column is None else docs[lang_column].cast("string")
    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"), lang.alias("lang"))
    return rows.mapInArrow(tidy(run), _SCHEMA.format(kind=kind))


def bands(measured: DataFrame, reach: float = REACH) -> DataFrame:
    """For each band_key (language, else script) and length_class the middle of each measure's band and half its width.

    A class of fewer than ``LEAST_TEXTS`` texts has no row; the row with length_class null is of
    all lengths. So few texts of a key have no row of their own at all; the row with band_key null
    is of all texts, however few. Quartiles are exact over all rows, of figures rounded to
    thousandths, so that a key's counts stay few and come together before the shuffle.
    """
    quartiles = [F.percentile(F.round(m, 3), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(m) for m in _MEASURES]
    by_class = measured.groupBy("band_key", "length_class").agg(F.count("*").alias("n"), *quartiles).filter(F.col("n") >= LEAST_TEXTS)
    no_class, no_key = F.lit(None).cast("int").alias("length_class"), F.lit(None).cast("string").alias("band_key")
    whole = measured.groupBy("band_key").agg(no_class, F.count("*").alias("n"), *quartiles).filter(F.col("n") >= LEAST_TEXTS)
    every = measured.agg(no_key, no_class, F.count("*").alias("n"), *quartiles).filter("n > 0")
    columns = []
    for m in _MEASURES:
        low, middle, high = (F.col(m)[i] for i in range(3))
        spread = F.greatest(high - low, LEAST_SPREAD * (F.lit(1.0) if m == "byte_share" else middle))
        columns += [((low + high) / 2).alias(f"{m}_middle"), ((high - low) / 2 + reach * spread).alias(f"{m}_width")]
    return by_class.unionByName(whole).unionByName(every).select("band_key", "length_class", *columns)


def quality(docs: DataFrame, model_path: str = MODEL, reach: float = REACH, id_column: str = "doc_id", text_column: str = "text", lang_column: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, the token figures, the failed measures and kept.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated 5-word windows. Such
    rows are not kept and do not shape the bands. The others are kept if all figures lie in the
    bands of their language or script and length class; a language or script of fewer than ``LEAST_TEXTS``
    texts has those of all texts. Null and empty texts have no words;
    repeated rows stay repeated; other columns are left out; an empty table gives an empty one.
    """
    measured = measures(docs, model_path, id_column, text_column, lang_column)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    measured = materialise(measured.withColumn("base_failed", failed).withColumn("band_key", F.coalesce(F.concat(F.lit("lang "), "lang"), F.concat(F.lit("script "), "script"))))
    measured = measured.withColumn("length_class", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))).cast("int"))
    judged = ~F.col("base_failed")
    limits = materialise(bands(measured.filter(judged), reach))
    by_class = small_side(limits.filter("length_class IS NOT NULL"))  # some rows for each language or script
    whole = small_side(limits.filter("band_key IS NOT NULL AND length_class IS NULL").select("band_key", *[F.col(c).alias(f"all_{c}") for c in limits.columns[2:]]))
    every = F.broadcast(limits.filter("band_key IS NULL").select(F.lit(True).alias("judged"), *[F.col(c).alias(f"any_{c}") for c in limits.columns[2:]]))  # one row at most
    wider = F.greatest(F.lit(1.0), F.sqrt(F.lit(float(BAND_TOKENS)) / F.greatest(F.col("n_tokens"), F.lit(1))))
    apart = []
    for m in _MEASURES:
        middle, all_middle = F.col(f"{m}_middle"), F.coalesce(f"all_{m}_middle", f"any_{m}_middle")
        all_width = F.coalesce(f"all_{m}_width", f"any_{m}_width")
        gap = F.abs(F.col(m) - all_middle) if m != "entropy" else all_middle - F.col(m)  # over all lengths entropy grows with the tokens
        within = F.abs(F.col(m) - middle) > F.col(f"{m}_width")
        apart.append(F.when(F.when(middle.isNotNull(), within).otherwise(gap > wider * all_width), F.lit(m)))
    out = F.array_compact(F.array(*apart))
    rated = measured.join(by_class, ["band_key", "length_class"], "left").join(whole, "band_key", "left").withColumn("judged", judged).join(every, "judged", "left")
    rated = rated.withColumn("outside", F.when(judged, F.coalesce(out, F.array())).otherwise(F.array().cast("array<string>")))
    rated = rated.withColumn("kept", ~F.col("base_failed") & (F.size("outside") == 0))
    return rated.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", *_MEASURES, "outside")
