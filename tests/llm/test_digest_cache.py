"""Token counts against the library, and what the cache spares."""

import json
import random

import pyarrow as pa
import pytest
import tokenizers

from claimscope.llm import digest_cache
from claimscope.llm.queries import registry

public_tokenizers = pytest.importorskip("public_tokenizers")


def _library(name):
    made = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: len(made.encode(text or "", add_special_tokens=False).ids)


def test_query_against_the_library(spark, sf_dir):
    count = _library("byte_bpe_50k.json")
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = registry.queries["op13_digest_cache"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = count(texts[r["doc_id"]])
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len((texts[r["doc_id"]] or "").encode()), n > 1024)


ODD = [None, "", " ", "a", "a", "<|endoftext|> x", "x<|endoftext|>y", "ＡＢ Ⅳ", "Ångström é", "Café CAFÉ", "<|ENDOFTEXT|>", "tab\t\n\n  end  ", "😀" * 50]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_odd_rows(spark, name):
    docs = spark.createDataFrame([(i % 3 or None, t, "x") for i, t in enumerate(ODD)], "doc_id int, text string, digest string")
    count = _library(name)
    found = digest_cache.count_tokens(docs, public_tokenizers.path(name)).collect()
    expected = [(str(i % 3 or None), len((t or "").encode()), count(t)) for i, t in enumerate(ODD)]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == sorted(expected)
    assert digest_cache.count_tokens(docs.limit(0), public_tokenizers.path(name)).count() == 0


def test_only_misses_are_encoded(spark, tmp_path, monkeypatch):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path)
    tokenizer = digest_cache.Tokenizer(path)
    first = spark.createDataFrame([(1, "One  two"), (2, "one two"), (3, "three")], "doc_id int, text string")
    assert digest_cache.count_tokens(first, path, cache).count() == 3
    assert digest_cache.stored(spark, cache, tokenizer).count() == 2  # the first two are one content
    more = first.unionAll(spark.createDataFrame([(4, "four words more here"), (5, "ONE TWO")], "doc_id int, text string"))
    before = {f.name for f in tmp_path.rglob("*.parquet")}
    found = {r["doc_id"]: r["n_tokens"] for r in digest_cache.count_tokens(more, path, cache).collect()}
    assert found == {r["doc_id"]: _library("word_bpe_49k.json")(r["text"]) for r in more.collect()}
    added = [str(f) for f in tmp_path.rglob("*.parquet") if f.name not in before]
    assert spark.read.parquet(*added).count() == 1
    known = digest_cache.stored(spark, cache, tokenizer)
    digests = digest_cache._digested(more, tokenizer, "doc_id", "text").groupBy("digest").count()
    assert digest_cache.missing_digests(digests, known).count() == 0
    # a second version of the tokenizer shares nothing, repeated entries are read as one
    assert digest_cache.stored(spark, cache, digest_cache.Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))).count() == 0
    spark.read.parquet(f"{cache}/version={tokenizer.version}").write.mode("append").parquet(f"{cache}/version={tokenizer.version}")
    assert digest_cache.stored(spark, cache, tokenizer).count() == 3


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_texts_against_whole_ones(name):
    """Texts of all kinds of white space, marks and letters, cut and whole."""
    dice = random.Random(3)
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path(name))
    signs = ["a", "Bc", "é", "日本", "7", "12", "'s", "'", "!", "?!", " ", "  ", "\n", "\t", "\r\n", "\xa0", "\u3000", "\u2028", "\x1f", "\x85", "\x0b", "<|endoftext|>", "<|", "😀", "\x00"]
    texts = ["".join(dice.choices(signs, k=dice.randint(0, 30))) for _ in range(4000)]
    found = digest_cache.PieceCounter(library, True).counts(pa.array(texts))
    assert found.to_pylist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert digest_cache.PieceCounter(library, True).counts(pa.array([], pa.string())).to_pylist() == []


def test_hot_text_and_many_others(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    count = _library("byte_bpe_50k.json")
    found = digest_cache.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: count("the same text" if i % 3 == 0 else f"text {i}") for i in range(6000)}


def test_long_texts_are_cut_without_a_change(spark, monkeypatch):
    said = "Some words, 12 numbers  and   spaces\n\n x's <|endoftext|> don't 9 % "
    texts = [said * 9000, "word" * 20_000, "a " * 300_000, "7 " * 300_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    count = _library("byte_bpe_50k.json")
    found, first = digest_cache.cut(pa.array(texts))
    assert first.tolist()[:2] == [0, 11 * 9000 + 1] and b"".join(found.to_pylist()) == "".join(texts).encode()
    found = {r["doc_id"]: r["n_tokens"] for r in digest_cache.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert found == {i: count(t) for i, t in enumerate(texts)}


PIECES = [
    "don't I'll we'RE it's 'S 's", "<|endoftext|> a<b <|startoftext|>x", "  two  spaces ", "a\n\nb\tc ", "\nWas it\n", "Ünï 漢字 ＡＢ １２ ½ 12345 a1b2",
    "x\x1fy \x7f\x00 z", "", " ", "'re're'", "ſ K İ I", "a b", "É́ été ÀÉ ß ÿ × ÷ aé1ö", "a\r\nb", "!!!??? ... ,;:\"'\"", "é" * 500,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_plain_pieces_have_the_counts_of_the_library(name):
    text = open(public_tokenizers.path(name), encoding="utf-8").read()
    library, split = tokenizers.Tokenizer.from_str(text), digest_cache.pre_tokens(json.loads(text))
    assert split(" Hello,") and split("été") and split("<") is None and split("漢") is None
    counter = digest_cache.PieceCounter(library, True, split)
    for _ in range(2):  # the second time from the kept counts
        assert counter.counts(pa.array(PIECES)).to_pylist() == [len(library.encode(x, add_special_tokens=False).ids) for x in PIECES]
    assert digest_cache.pre_tokens({"model": {"type": "Unigram"}})("a") is None
