import random

import numpy as np
import pytest

from stratalake.llm import jaccard
from stratalake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, node string, n int"


def brute(rows):
    sets = []
    for doc_id, text in rows:
        words = (text or "").encode().lower().split()
        k = min(5, len(words))
        sets.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set())
    label = {d: d for d, _ in rows if d is not None}

    def root(d):
        while label[d] != d:
            d = label[d]
        return d

    for i, (a, _) in enumerate(rows):
        for j, (b, _) in enumerate(rows[:i]):
            if a is not None and b is not None and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return sorted(((d, len(s), root(d) if d is not None else None) for (d, _), s in zip(rows, sets)), key=str)


def texts(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(60)]
    out = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 5, 8, 40, 120, 400]))]
        out.append(base)
        for _ in range(r.randint(0, 6)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(copy) // 25))):
                copy[r.randrange(len(copy))] = word()
            out.append(copy)
    out += [passage + [word() for _ in range(r.choice([5, 12, 15, 16, 20, 60]))] for _ in range(40)]
    return [" ".join(w).upper() if r.random() < 0.2 else " ".join(w) for w in out]


@pytest.mark.parametrize("block", [1024, 5])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", block * 40)
    rows = [(i + 10, t) for i, t in enumerate(texts(block))]
    rows += [(1, None), (2, ""), (3, " \t"), (4, "a b"), (5, "A  B"), (5, "a b"), (6, "ÄÖ x"), (7, "äö x"), (None, "a b"), (None, None)]
    df = spark.createDataFrame([(*r, "en", None, "x", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, jaccard.jaccard_components(df, Scratch(spark, "t")).collect()), key=str)
    assert got == brute(rows)


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (9, ""), (8, None), (None, "a b c d e f"), (4, "q r s")]
    df = spark.createDataFrame([(*r, "en", None, "x", 1) for r in rows], SCHEMA)
    kept = jaccard.keep_one(df, Scratch(spark, "t"))
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 4, 8, 9, None]


def test_bit_counts_never_hide_a_link():
    r = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, r.integers(1, 300), dtype=np.uint64))
        b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 1 << 63, r.integers(0, 30), dtype=np.uint64)]))
        if not len(b):
            continue
        words = min(len(jaccard.signature(a)), len(jaccard.signature(b)))
        p, q = (jaccard.fold(jaccard.signature(x), words) for x in (a, b))
        may = jaccard.may_link(p, len(a), q[None], np.array([len(b)]), np.bitwise_count(q[None]).sum(1, dtype=np.int64))[0]
        exact = 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b))
        assert jaccard.linked(a, b) == exact and (may or not exact)


def test_empty_table(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], SCHEMA), Scratch(spark, "t")).count() == 0


def test_live_sets_of_rows_with_one_doc_id(spark):
    texts = [" ".join(f"{k}{i}" for i in range(40)) for k in "ab"]
    docs = spark.createDataFrame([(1, t) for t in texts], "doc_id long, text string")
    sets = [jaccard.Shingler().set(t.encode()) for t in texts]
    live = spark.createDataFrame([(jaccard.node_of(s), i, len(s), 1) for i, s in enumerate(sets)], "hash binary, node long, n long, doc_id long")
    assert sorted((r.node, bytes(r.shingles)) for r in jaccard.live_sets(docs, live).collect()) == [(i, s.tobytes()) for i, s in enumerate(sets)]


def test_rows_with_one_doc_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(40)) for k in "abc")
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b + " tail"), (8, c)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(docs, Scratch(spark, "t")).collect())
    assert got == [(3, 3), (5, 3), (5, 3), (7, 3), (8, 8)]


def test_copies_that_link_through_one_text_give_one_link_each(spark, monkeypatch):
    """Two thousand copies, each with a part of its own: they link with the base, hardly with each other."""
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    r, n = random.Random(5), 2000
    base = [f"w{i}" for i in range(104)]
    rows = [(0, " ".join(base))]
    for k in range(1, n):
        copy = list(base)
        for i in r.sample(range(2, 102), 2):
            copy[i] = f"x{k}.{i}"
        rows.append((k, " ".join(copy)))
    scratch, made = Scratch(spark, "t"), []
    whole = jaccard.tile_edges
    monkeypatch.setattr(jaccard, "tile_edges", lambda *a: made.append(whole(*a)) or made[0])
    monkeypatch.setattr(Scratch, "drop", lambda *a: None)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), scratch)
    assert {x.component_id for x in got.collect()} == {0}
    keys = spark.read.parquet(scratch.path("mixed")).count()
    assert made[0].count() < 4 * n and keys > 1


def test_very_long_text(spark):
    long = " ".join(f"w{i % 70001}" for i in range(300_000))
    docs = spark.createDataFrame([(1, long), (2, long + " end"), (3, "end")], "doc_id long, text string")
    got = sorted(map(tuple, jaccard.jaccard_components(docs, Scratch(spark, "t")).collect()))
    assert got == [(1, 70001, 1), (2, 70002, 1), (3, 1, 3)]
