"""SentencePiece models run by the tokenizers library.

The model file is a protobuf message. It is read field by field, and normaliser, metaspace
marker, scores (unigram) or merges (BPE) and byte fallback are rebuilt as a ``Tokenizer``, which
encodes a batch of texts on several threads. ``parity_mismatches`` holds the ids against the
sentencepiece library.
"""

from __future__ import annotations

import functools
import os
import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from claimscope.llm.arrays import pieces
from claimscope.llm.tables import tidy

MODEL = "/opt/tokenizers/piece_bpe_32k.model"

#: Model files above this size are refused: their bytes go to every Python worker.
MODEL_BYTES = 64 << 20

#: Bytes of text that are encoded at once.
BATCH_BYTES = 1 << 20

#: Words that a Python worker keeps with their ids; a batch of more is held for as long as it is encoded.
CACHED_WORDS = 300_000

# fixed values: kinds of pieces and of models in the message
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARK = "▁"


@dataclass
class Model:
    """What the message says; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra_spaces: bool = True
    escape_spaces: bool = True

    @property
    def unknown(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)

    @property
    def cuts_at_marks(self) -> bool:
        """No piece has the marker after another character, so every encoding has a cut before each run of markers."""
        return not self.remove_extra_spaces and (MARK, NORMAL) in {(p, k) for p, _, k in self.pieces} and not any(re.search(f"[^{MARK}]{MARK}", p) or k == USER_DEFINED for p, _, k in self.pieces)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message."""
    at, end = 0, len(message)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = {1: 8, 5: 4}.get(wire)
        if size is None:
            if wire != 2:
                raise ValueError(f"wire type {wire} in a model file")
            size = varint()
        if at + size > end:
            raise ValueError("the model file is cut off")
        yield number, message[at : at + size]
        at += size


def parse(message: bytes) -> Model:
    model = Model()
    for number, value in _fields(message):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    text = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append((text, score, kind))
        elif number == 2:
            spec = dict(_fields(value))
            model.kind = spec.get(3, UNIGRAM)
            model.byte_fallback = bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            model.charsmap = spec.get(2, b"")
            model.dummy_prefix = bool(spec.get(3, 1))
            model.remove_extra_spaces = bool(spec.get(4, 1))
            model.escape_spaces = bool(spec.get(5, 1))
    if model.kind not in (UNIGRAM, BPE):
        raise ValueError(f"models of kind {model.kind} are not supported")
    if not model.escape_spaces:
        raise ValueError("a model without the metaspace marker is not supported")
    return model


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the best piece first."""
    score = {p: s for p, s, kind in model.pieces if kind in (NORMAL, USER_DEFINED)}
    found = []
    for rank, (piece, s) in enumerate(score.items()):
        for cut in range(1, len(piece)):
            if piece[:cut] in score and piece[cut:] in score:
                found.append((-s, rank, piece[:cut], piece[cut:]))
    return [(a, b) for _, _, a, b in sorted(found)]


def build(model: Model):
    """The model as a ``tokenizers.Tokenizer``."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    ids = {piece: i for i, (piece, _, _) in enumerate(model.pieces)}
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], model.unknown, model.byte_fallback)
    else:
        core = models.BPE(ids, merges(model), unk_token=model.pieces[model.unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    steps += [normalizers.Prepend(MARK)] * model.dummy_prefix + [normalizers.Replace(" ", MARK)]
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.kind == BPE and model.cuts_at_marks:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    own = [AddedToken(p, normalized=False) for p, _, kind in model.pieces if kind == USER_DEFINED]
    if own:
        tokenizer.add_tokens(own)
    tail = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *tail])
    return tokenizer


class Codec:
    """Text to ids and back, as the sentencepiece library does it.

    Where no piece goes on across a metaspace marker, a text's ids are those of its words put
    together; each word is then encoded (and decoded, to see that it comes back) once per worker
    and kept in a table of at most ``CACHED_WORDS`` words. Texts with leading, trailing or
    repeated spaces, and all texts of other models, are encoded as a whole. With one thread a word
    goes straight to the BPE model, as it is one pre-token: a batch would make an encoding of each.
    Without ``checked`` it is not worked out whether words come back.
    """

    def __init__(self, message: bytes, threads: int = 1, checked: bool = True) -> None:
        if threads > 1:
            os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = parse(message)
        self.tokenizer = build(self.model)
        self.is_byte = np.array([kind == BYTE for _, _, kind in self.model.pieces])
        self.by_word = self.model.cuts_at_marks and self.model.dummy_prefix and not self.model.charsmap
        #: the bytes that each id stands for
        self.surfaces = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in self.model.pieces]
        self.checked = checked
        own = any(kind == USER_DEFINED for _, _, kind in self.model.pieces)
        self.core = self.tokenizer.model if threads == 1 and self.by_word and self.model.kind == BPE and not own else None
        self._ids: dict[str, bytes] = {}
        self._lossy: set[str] = set()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return self._encode(texts)[0]

    def encode_checked(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each text, and whether they decode to it."""
        if not self.checked:
            raise ValueError("this codec does not check what it encodes")
        return self._encode(texts)

    def _words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        if self.core is None:
            return [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        found = []
        for w in words:
            one = w and MARK not in w and not (self.model.remove_extra_spaces and w != w.strip())
            found.append([t.id for t in self.core.tokenize(MARK + w)] if one else self.tokenizer.encode(w, add_special_tokens=False).ids)
        return found

    def _encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        words = [x.split(" ") if self.by_word and x and "  " not in x and x[0] != " " != x[-1] else None for x in texts]
        self.learn({w for x in words if x is not None for w in x})
        whole = [x for x, w in zip(texts, words) if w is None]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        rest = iter(zip(encoded, whole, self.decode(encoded) if self.checked else whole))
        ids, back = [], []
        for x in words:
            if x is None:
                found, text, again = next(rest)
                ids.append(np.array(found, np.int32))
                back.append(text == again)
            else:
                ids.append(np.frombuffer(b"".join(map(self._ids.__getitem__, x)), np.int32))
                back.append(self._lossy.isdisjoint(x))
        return ids, back

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Make sure that the table has these words; the table."""
        new = list(words.difference(self._ids))
        if len(self._ids) + len(new) > CACHED_WORDS:
            self._ids.clear()
            self._lossy.clear()
            new = list(words)
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            ids = self._words(part)
            self._ids.update((w, array("i", i).tobytes()) for w, i in zip(part, ids))
            if self.checked:
                surface = self.surfaces.__getitem__
                self._lossy.update(w for w, i in zip(part, ids) if b"".join(map(surface, i)) != b" " + w.encode())
        return self._ids

    def forget(self) -> None:
        """Empty the table: a worker that waits for its next task holds the model alone."""
        self._ids, self._lossy = {}, set()

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False) if ids else []


@functools.lru_cache(2)
def codec(message: bytes, threads: int = 1, checked: bool = True) -> Codec:
    """One codec for each model in a Python worker."""
    return Codec(message, threads, checked)


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        message = file.read(MODEL_BYTES + 1)
    if len(message) > MODEL_BYTES:
        raise ValueError(f"{path} has more than {MODEL_BYTES} bytes")
    return message


def encode(docs: DataFrame, model_path: str = MODEL, id_column: str = "doc_id", text_column: str = "text", threads: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_byte_tokens, ids, round_trip.

    ``round_trip`` says whether decoding ids gives the text back. A null text gives null ids,
    no tokens and round_trip true; an empty one an empty list. Repeated rows stay repeated, other
    columns are left out whatever their names, an empty table gives an empty one.
    """
    message = read_model(model_path)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(message, threads)
        own.forget()
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                texts = part.column("text").to_pylist()
                ids, back = own.encode_checked([x or "" for x in texts])
                counts = np.fromiter(map(len, ids), np.int64, len(ids))
                offsets = np.concatenate(([0], np.cumsum(counts)))
                flat = np.concatenate([np.zeros(0, np.int32), *ids])
                bytes_before = np.concatenate(([0], np.cumsum(own.is_byte[flat])))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat), mask=part.column("text").is_null())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), pa.array(counts), pa.array(bytes_before[offsets[1:]] - bytes_before[offsets[:-1]]),
                        lists, pa.array(back, pa.bool_()),
                    ],
                    ["doc_id", "n_tokens", "n_byte_tokens", "ids", "round_trip"],
                )
        own.forget()

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_path: str = MODEL, id_column: str = "doc_id", ids_column: str = "ids", threads: int = 2) -> DataFrame:
    """doc_id and text of each row of ids; null ids give a null text."""
    message = read_model(model_path)
    kind = encoded.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(message, threads)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            texts = own.decode([x or [] for x in ids])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if i is None else t for i, t in zip(ids, texts)], pa.string())], ["doc_id", "text"])

    rows = encoded.select(encoded[id_column].alias("doc_id"), encoded[ids_column].alias("ids"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, text string")


def parity_mismatches(docs: DataFrame, model_path: str = MODEL, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and both id lists of each text that the sentencepiece library encodes to other ids."""
    message = read_model(model_path)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from sentencepiece import SentencePieceProcessor

        own, theirs = codec(message), SentencePieceProcessor(model_proto=message)
        for batch in batches:
            for part in pieces(batch, "text", BATCH_BYTES):
                texts = [x or "" for x in part.column("text").to_pylist()]
                a, b = own.encode(texts), theirs.encode(texts, num_threads=1)
                a = [x.tolist() for x in a]
                bad = [i for i, (x, y) in enumerate(zip(a, b)) if x != y]
                kinds = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(bad, pa.int64())), pa.array([a[i] for i in bad], kinds), pa.array([b[i] for i in bad], kinds)], ["doc_id", "ids", "expected"])

    rows = docs.select(docs[id_column].alias("doc_id"), docs[text_column].alias("text"))
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, ids array<int>, expected array<int>")
