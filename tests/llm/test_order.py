import numpy as np
import pytest

from stratalake.llm import order
from stratalake.llm.common import Scratch

SCHEMA = "doc_id long, text string, slot string, shard int"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    slots = order.feistel(np.arange(n), n, 7)
    assert sorted(slots) == list(range(n))
    if n > 60:
        assert (slots != order.feistel(np.arange(n), n, 8)).any()
        assert (slots != np.arange(n)).mean() > 0.9


def stream(texts, vocabulary):
    tokens = order.Tokeniser(vocabulary)
    whole = []
    for t in texts:
        if t:
            whole += tokens.encoding.encode_ordinary(t) + [order.END]
    return whole


def test_shards_hold_the_stream(spark, tmp_path):
    texts = ["one two  three\n four", None, "", "a " * 500, "naïve — text", "x", "one two  three\n four", " lead and trail "] * 3
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], SCHEMA)
    docs.coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    manifest = order.materialise_order(docs, Scratch(spark, "t"), seq_len=64, shard_sequences=7)
    rows = {r.slot: r for r in manifest.collect()}
    want = stream(texts, open(order.VOCABULARY, "rb").read())
    n = -(-len(want) // 64)
    assert sorted(rows) == list(range(n))
    got = dict(order.read_slots(manifest))
    by_sequence = {rows[s].sequence: got[s][: rows[s].n_tokens] for s in got}
    assert np.concatenate([by_sequence[i] for i in range(n)]).tolist() == want
    assert all(rows[s].offset == s % 7 * 128 and rows[s].shard == s // 7 for s in rows)
    later = list(order.read_slots(manifest, 5, 9))
    assert [s for s, _ in later] == list(range(5, min(14, n))) and all((t == got[s]).all() for s, t in later)
    again = order.materialise_order(docs, Scratch(spark, "t"), seq_len=64, shard_sequences=7)
    assert {(r.slot, r.sequence, tuple(r.doc_ids)) for r in again.collect()} == {(r.slot, r.sequence, tuple(r.doc_ids)) for r in rows.values()}


def test_words_from_the_cache_are_the_whole_texts_tokens():
    tokens = order.Tokeniser(open(order.VOCABULARY, "rb").read())
    for t in ("it's 12 o'clock, isn't it?", "Ärger über ###", "a\nb c\td", "tab\t x", "no break  x", " a", "a "):
        for _ in range(2):
            assert np.frombuffer(tokens.encode(t), "<u2").tolist() == tokens.encoding.encode_ordinary(t)


def test_empty_and_unscanned_tables(spark):
    assert order.materialise_order(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0
    joined = spark.createDataFrame([(1, "a b", "s", 1)], SCHEMA).groupBy("doc_id").agg({"text": "max"}).withColumnRenamed("max(text)", "text")
    assert order.materialise_order(joined, Scratch(spark, "t")).first().doc_ids == [1]
