import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from stratalake.llm import token_cache
from stratalake.llm.common import Scratch
from stratalake.llm.token_cache import TokenCache, Tokenizer, count_tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, digest string, content string, n_tokens string"


@pytest.fixture(scope="module")
def coder():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvwäöé漢▁\U0001f600") for _ in range(rng.randint(1, 9)))
    gap = lambda: rng.choice([" ", " ", " ", "  ", "\n", "\t ", " ▁", " ", "   "])
    out = ["", " ", "  two", "a", "<s> </s> <unk>", "line\nline\r\n", "▁", "é", "x" * 300, "\x00nul"]
    return out + ["".join(word() + gap() for _ in range(n)) for n in (3, 40, 500, 4000)]


def test_counts_equal_the_librarys(spark, coder, tmp_path):
    found = texts()
    rows = [(i, t, "d", "c", "n") for i, t in enumerate(found)] + [(100 + i, found[11], "d", "c", "n") for i in range(50)] + [(None, None, None, None, None), (7, None, "x", "y", "z")]
    cache = TokenCache(spark, f"file://{tmp_path}/cache")
    got = count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(5), cache, Tokenizer(MODEL), Scratch(spark, "t"), limit=100).collect()
    want = sorted((str(i), len((t or "").encode()), len(coder.encode(t or "")), len(coder.encode(t or "")) > 100) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want


def test_parts_of_long_texts_add_up(spark, coder, monkeypatch, tmp_path):
    monkeypatch.setattr(token_cache, "PART", 64)
    rng = random.Random(9)
    for t in texts():
        data = t.encode()
        cut = list(token_cache.parts(data, 64))
        assert sum(len(coder.encode(p)) for p in cut) == len(coder.encode(t)), t[:80]
        assert len(data) < 1000 or len(cut) > 5 or " " not in t
    long = " ".join("".join(rng.choice("aeionrst") for _ in range(rng.randint(1, 8))) for _ in range(400_000))
    df = spark.createDataFrame([(1, long, "", "", "")], SCHEMA)
    monkeypatch.setattr(token_cache, "PART", 1 << 16)
    got = count_tokens(df, TokenCache(spark, f"file://{tmp_path}/c"), Tokenizer(MODEL), Scratch(spark, "t")).first()
    assert got.n_bytes == len(long) and got.n_tokens == len(coder.encode(long)) and got.over_limit


def encoded(cache, version):
    return cache.counts(version).count()


def test_only_misses_are_encoded(spark, coder, tmp_path):
    cache, tokenizer = TokenCache(spark, f"file://{tmp_path}/cache"), Tokenizer(MODEL)
    version = tokenizer.version()
    docs = spark.createDataFrame([(i, f"text {i % 7}", "", "", "") for i in range(90)], SCHEMA)
    first = count_tokens(docs, cache, tokenizer, Scratch(spark, "t")).collect()
    assert encoded(cache, version) == 7
    # A stored count is taken as it is: the text is not encoded again.
    key = hashlib.sha256(b"kept").digest()
    cache.append(spark.createDataFrame([(key, 4711)], TokenCache.SCHEMA), version)
    more = docs.unionByName(spark.createDataFrame([(500, "kept", "", "", ""), (501, "new", "", "", "")], SCHEMA))
    again = count_tokens(more, cache, tokenizer, Scratch(spark, "t")).collect()
    assert encoded(cache, version) == 9 and {r.doc_id: r.n_tokens for r in again} == {r.doc_id: r.n_tokens for r in first} | {500: 4711, 501: len(coder.encode("new"))}
    # Two runs at once may both append a key: no row is doubled.
    cache.append(cache.counts(version), version)
    assert len(count_tokens(more, cache, tokenizer, Scratch(spark, "t")).collect()) == len(again)
    # Another version knows nothing.
    other = Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert other.version() != version and encoded(cache, other.version()) == 0


def test_other_libraries_and_normalisers(spark, tmp_path):
    cache = TokenCache(spark, f"file://{tmp_path}/cache")
    docs = spark.createDataFrame([(1, "Hello  World <|endoftext|>", "", "", ""), (2, "hello  world <|endoftext|>", "", "", ""), (3, None, "", "", "")], SCHEMA)
    path = public_tokenizers.path("word_bpe_49k.json")
    coder = tokenizers.Tokenizer.from_file(path)
    got = count_tokens(docs, cache, Tokenizer(path), Scratch(spark, "t"), normalise=F.lower, normaliser="lower").collect()
    want = len(coder.encode("Hello  World <|endoftext|>", add_special_tokens=False).ids)
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == {1: (26, want), 2: (26, want), 3: (0, 0)}
    assert encoded(cache, Tokenizer(path).version("lower")) == 2
    ranks = Tokenizer(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    plain = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    got = count_tokens(docs, cache, ranks, Scratch(spark, "t")).collect()
    assert {r.n_tokens for r in got if r.doc_id == 1} == {len(plain.encode("Hello  World <|endoftext|>", add_special_tokens=False).ids)}
    for bad in (lambda: Tokenizer("x.bin"), lambda: Tokenizer("x.tiktoken"), lambda: count_tokens(docs, cache, ranks, Scratch(spark, "t"), normalise=F.lower)):
        with pytest.raises(ValueError):
            bad()


def test_no_rows(spark, tmp_path):
    assert count_tokens(spark.createDataFrame([], SCHEMA), TokenCache(spark, f"file://{tmp_path}/c"), Tokenizer(MODEL), Scratch(spark, "t")).count() == 0
