"""Token counts from a cache keyed by what was counted and by what counted it.

A row of the cache says: this content (SHA-256 of the text as the tokenizer's normaliser leaves
it) has so many tokens under that tokenizer (SHA-256 of its file, the library's version and the
way it is called). Texts are digested on the executors, each digest is looked up once, only the
distinct texts that are missing are sent to the tokenizer, their counts are appended to the cache
and every row gets its count by its digest.

The cache is a folder of Parquet files, one sub-folder a tokenizer version. Files are only ever
added, by Spark's committer: a job that dies leaves nothing half written, and two jobs that count
the same text at the same time leave two equal rows, which a look-up reads as one.

What the rows give: a null text counts as an empty one (0 tokens, 0 bytes). Null and repeated ids
keep their rows, each with its own count; other columns are not read. Very long texts are cut
where the vocabulary's own pre-tokeniser cuts (where white space begins), so that no single
encoding grows with the text, and the counts of the pieces add up to that of the whole. Equal
pieces of a batch, mostly words, are encoded once.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from claimscope.llm.arrays import pieces, utf8
from claimscope.llm.tables import BROADCAST_ROWS, tidy
from claimscope.session import materialise, scratch_path

#: Tokenizer files above this size are refused: their text goes to every Python worker.
FILE_BYTES = 64 << 20

#: Bytes of text encoded at once; a longer text is a batch of its own.
BATCH_BYTES = 1 << 20

#: Distinct pieces whose counts a task keeps; when there are more it begins anew.
KEPT_PIECES = 400_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True

#: A digest with more than this share of all rows is looked up by a broadcast, so there are fewer than 1000 of them.
HOT_SHARE = 0.001

#: How the library is called; part of the version.
_CALL = "encode_batch_fast, special strings as by default, none added, no truncation, no padding"

_CACHE = "digest binary, n_tokens long"


class Tokenizer:
    """A tokenizers file as text, and the digest of everything its counts depend on."""

    def __init__(self, path: str) -> None:
        import tokenizers

        with open(path, encoding="utf-8") as file:
            self.text = file.read(FILE_BYTES + 1)
        if len(self.text) > FILE_BYTES:
            raise ValueError(f"{path} has more than {FILE_BYTES} bytes")
        said = json.loads(self.text)
        self.split = pre_tokens(said)
        self.version = hashlib.sha256("\n".join((_CALL, tokenizers.__version__, self.text)).encode()).hexdigest()
        self.normalises = said.get("normalizer") is not None
        self.added = [t["content"] for t in said.get("added_tokens", [])]
        before = said.get("pre_tokenizer") or {}
        #: Whether a text may be cut where white space begins without a change of its tokens.
        self.cuts_at_spaces = not self.normalises and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True) and not any(
            any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in said.get("added_tokens", [])
        )

    def load(self):
        import tokenizers

        made = tokenizers.Tokenizer.from_str(self.text)
        made.no_truncation()
        made.no_padding()
        return made


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts cut where white space begins after a printable ASCII character, and the number of pieces before each text.

    No pre-token of the byte-level pattern reaches across such a place, and what follows it is
    split without looking back.
    """
    data, offsets = utf8(texts)
    at = np.zeros(len(data) + 1, bool)
    at[1:-1] = _SPACE[data[1:]] & _PRINTABLE[data[:-1]]
    at[offsets] = True
    cuts = np.flatnonzero(at)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    return pieces, np.searchsorted(cuts, offsets)


# fixed values: what the byte-level pre-tokeniser, and that of the word vocabulary, take as one pre-token
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_BYTE_LEVEL = _CONTRACTIONS + r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
_WORD_LEVEL = _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORD_NORMALISER = ["NFC", "Replace", "Lowercase"]

#: Letters of plain pieces: no normal form changes them, and lower case is the same everywhere.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


def pre_tokens(said: dict) -> Callable[[str], list[str] | None]:
    """A function that splits a piece as the tokenizers file ``said`` does, into what its model takes.

    It gives None for pieces that the library has to split: those of other characters than printable
    ASCII and Latin-1 letters (after one space or line end at most), or with a character that an
    added token begins with, and all of other files.
    """
    from tokenizers import pre_tokenizers

    before, normaliser = said.get("pre_tokenizer") or {}, said.get("normalizer") or {}
    if said.get("model", {}).get("type") != "BPE":
        return lambda piece: None
    begun = {t["content"][:1] for t in said.get("added_tokens", [])}
    printable = "".join(re.escape(chr(c)) for c in range(0x21, 0x7F) if not chr(c).isalpha() and chr(c) not in begun)
    plain = re.compile(f"[ \n]?[{printable}{_LETTERS}]+").fullmatch if not any(c.isalpha() for c in begun) else lambda piece: None
    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    table = {c: "".join(x for x, _ in as_bytes.pre_tokenize_str(chr(c))) for c in [0x0A, 0x20, *range(0xC0, 0x100)]}

    def finder(pattern: str) -> Callable[[str], list[str]]:
        pattern = pattern.replace(r"[\p{L}]", r"\p{L}").replace(r"[\p{N}]", r"\p{N}").replace(r"[^\s\p{L}\p{N}]", f"[^\\s{_LETTERS}0-9]")
        return re.compile(pattern.replace(r"\p{L}", f"[{_LETTERS}]").replace(r"\p{N}", "[0-9]")).findall

    def mapped(parts: list[str]) -> list[str]:
        """Each byte as the character that stands for it in the vocabulary."""
        return [x if x.isascii() and x[0] > " " else "Ġ" + x[1:] if x.isascii() and x[0] == " " else x.translate(table) for x in parts]

    if not normaliser and before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True):
        find = finder(_BYTE_LEVEL)
        return lambda piece: mapped(find(piece)) if plain(piece) else None
    steps = before.get("pretokenizers", [])
    splits = [x.get("pattern", {}).get("Regex") for x in steps]
    names = [x.get("type") for x in normaliser.get("normalizers", [])]
    if splits == [_WORD_LEVEL, None] and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and names == _WORD_NORMALISER and not steps[1].get("add_prefix_space", True):
        find = finder(_WORD_LEVEL)
        return lambda piece: mapped(find(piece.lower())) if plain(piece) else None
    return lambda piece: None


class Pieces:
    """The distinct pieces of texts (none is null), and which of them each text has."""

    def __init__(self, texts: pa.Array) -> None:
        found, self.first = cut(texts)
        coded = found.dictionary_encode()
        self.distinct = coded.dictionary.cast(pa.large_string()).to_pylist()
        self.places = coded.indices.to_numpy(zero_copy_only=False)

    def sums(self, counts: np.ndarray) -> pa.Array:
        """For each text the sum of its pieces' counts."""
        before = np.zeros(len(self.places) + 1, np.int64)
        np.cumsum(counts[self.places], out=before[1:])
        return pa.array(before[self.first[1:]] - before[self.first[:-1]])


class PieceCounter:
    """Counts the tokens of texts; of the pieces that are equal one is encoded.

    ``split`` (``pre_tokens``) lets plain pieces go straight to the library's model; the others are
    encoded in batches, which make an encoding with all its columns of each. The counts of at most
    ``KEPT_PIECES`` short pieces are kept from call to call, so a counter is made for a task and
    goes with it. Without ``cuts_at_spaces`` texts are encoded whole.
    """

    def __init__(self, library, cuts_at_spaces: bool, split: Callable[[str], list[str] | None] = lambda piece: None) -> None:
        self.library, self.cuts_at_spaces, self.split = library, cuts_at_spaces, split
        self.kept: dict[str, int] = {}

    def _encoded(self, texts: list[str]) -> list[int]:
        tokens, counts, rest = self.library.model.tokenize, [], []
        for x in texts:
            parts = self.split(x)
            if parts is None:
                rest.append(x)
                counts.append(None)
            else:
                counts.append(len(tokens(parts[0])) if len(parts) == 1 else sum([len(tokens(p)) for p in parts]))
        whole = map(len, self.library.encode_batch_fast(rest, add_special_tokens=False))
        return [next(whole) if n is None else n for n in counts]

    def counts(self, texts: pa.Array) -> pa.Array:
        """The number of tokens of each text (none is null)."""
        if not self.cuts_at_spaces:
            return pa.array([len(e) for e in self.library.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)], pa.int64())
        return self.of_pieces(Pieces(texts))

    def of_pieces(self, found: Pieces) -> pa.Array:
        """The number of tokens of each text whose pieces these are."""
        if len(self.kept) + len(found.distinct) > KEPT_PIECES:
            self.kept = {}
        counts = [self.kept.get(x) for x in found.distinct]
        new = [x for x, n in zip(found.distinct, counts) if n is None]
        encoded = self._encoded(new)
        self.kept.update((x, n) for x, n in zip(new, encoded) if len(x) <= 64)
        fresh = iter(encoded)
        return found.sums(np.array([next(fresh) if n is None else n for n in counts], np.int64))


def _encoder(tokenizer: Tokenizer):
    """A function of Arrow batches (digest, text) that counts the tokens of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        counter = PieceCounter(tokenizer.load(), tokenizer.cuts_at_spaces, tokenizer.split)
        for batch in batches:
            for piece in pieces(batch, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([piece.column("digest"), counter.counts(piece.column("text"))], names=["digest", "n_tokens"])

    return count


def _contents(tokenizer: Tokenizer):
    """A function of Arrow batches (doc_id, n_bytes, text) that adds what the digest is made of.

    That is the normalised text. Added tokens are looked for in the text as given, so one that
    holds such a string, before or after, stands for itself alone.
    """

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer.load().normalizer
        for batch in batches:
            contents = []
            for text in batch.column("text").to_pylist():
                normal = own.normalize_str(text)
                contents.append("as given:" + text if any(t in text or t in normal for t in tokenizer.added) else "normal:" + normal)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(contents, pa.string())], names=["doc_id", "n_bytes", "text", "content"])

    return normalise


def _digested(docs: DataFrame, tokenizer: Tokenizer, id_column: str, text_column: str) -> DataFrame:
    """Rows (doc_id, n_bytes, text, digest): the text as given, the digest of its normalised content."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_column}`").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    content: Column = F.col("text")
    if tokenizer.normalises:
        kind = rows.schema["doc_id"].dataType.simpleString()
        rows, content = rows.mapInArrow(tidy(_contents(tokenizer)), f"doc_id {kind}, n_bytes long, text string, content string"), F.col("content")
    return rows.select("doc_id", "n_bytes", "text", F.unhex(F.sha2(content, 256)).alias("digest"))


def stored(spark: SparkSession, cache: str, tokenizer: Tokenizer) -> DataFrame:
    """The counts in the cache for this version of the tokenizer, each digest once."""
    try:
        found = spark.read.schema(_CACHE).parquet(f"{cache}/version={tokenizer.version}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        found = spark.createDataFrame([], _CACHE)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def missing_digests(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The digests of ``rows`` (digest, n_rows) that the cache does not have."""
    return rows.join(known.select("digest"), "digest", "left_anti").select("digest")


def count_tokens(docs: DataFrame, path: str, cache: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens): the tokens of every text under the tokenizers file at ``path``.

    ``cache`` is a folder that all executors reach; without one the counts are kept for this call only.
    """
    spark = docs.sparkSession
    tokenizer = Tokenizer(path)
    cache = cache or scratch_path(spark)
    rows = _digested(docs, tokenizer, id_column, text_column)
    known = stored(spark, cache, tokenizer)
    digests = materialise(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows")))
    missing = materialise(missing_digests(digests, known))
    n_missing = missing.count()
    if n_missing:
        texts = rows.select("digest", "text")
        if n_missing <= BROADCAST_ROWS:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
        # equal texts are put together before they travel, whatever their number
        texts = texts.groupBy("digest").agg(F.first("text").alias("text"))
        if n_missing > BROADCAST_ROWS:
            texts = texts.join(missing, "digest", "left_semi")
        counted = texts.select("digest", "text").mapInArrow(tidy(_encoder(tokenizer)), _CACHE)
        counted.write.mode("append").parquet(f"{cache}/version={tokenizer.version}")
    counts = stored(spark, cache, tokenizer)
    total = digests.agg(F.sum("n_rows")).first()[0] or 0
    hot = materialise(counts.join(digests.filter(F.col("n_rows") > F.lit(total * HOT_SHARE)).select("digest"), "digest", "left_semi"))
    hot = F.broadcast(hot.select("digest", F.col("n_tokens").alias("hot_tokens")))
    found = rows.select("doc_id", "n_bytes", "digest").join(hot, "digest", "left")
    direct = found.filter(F.col("hot_tokens").isNotNull()).select("doc_id", "n_bytes", F.col("hot_tokens").alias("n_tokens"))
    looked_up = found.filter(F.col("hot_tokens").isNull()).join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")
    return direct.unionAll(looked_up)
