import random
import re
from collections import Counter, defaultdict

import pytest

from stratalake.llm import divergence
from stratalake.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, term string, value string, n string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, min_docs=3, top=200):
    """The contract in plain Python integers."""
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(LOWER))) for r in rows]
    seen, groups, counts, total = defaultdict(Counter), set(), defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in docs:
        groups.add((lang, source))
        counts[lang, source].update(words)
        total[lang].update(words)
        seen[lang].update(set(words))
    kept = {lang: [t for t, n in seen[lang].items() if n >= min_docs] for lang in {g[0] for g in groups}}

    def shares(count, lang):
        size = sum(count[t] for t in kept[lang]) + len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 1) // size for t in kept[lang]}

    p = {g: shares(counts[g], g[0]) for g in groups}
    q = {lang: shares(total[lang], lang) for lang in kept}
    f = lambda a, b: (a - b) ** 2 // b
    out = []
    for g in groups:
        pair = [(sum(f(p[g][t], p[h][t]) for t in kept[g[0]]), h[1]) for h in groups if h[0] == g[0] and h != g]
        term = [(f(p[g][t], q[g[0]][t]), t) for t in kept[g[0]] if counts[g][t] and p[g][t] > q[g[0]][t]]
        for part, found, most in (("pair", pair, None), ("term", term, top)):
            for i, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]):
                out.append((*g, part, item, v, i + 1))
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "GAMMA", "été", "ÉTÉ", "straße", "漢字", "x", "İs"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", None]) if rng.random() < 0.7 else "a"
        base = {"a": 3, "b": 40, "c": 90}.get(source, 0)
        text = " ".join(words[min(int(abs(rng.gauss(base, 30))), len(words) - 1)] + rng.choice(["", ".", "1", "-"]) for _ in range(rng.randint(0, 60)))
        rows.append((i % 50, text if rng.random() > 0.05 else None, lang, source, "t", "v", "n"))
    return rows + [(1, "!!! 123", "fr", "none", "", "", ""), (2, "un deux", "fr", "few", "", "", ""), (3, "alone", "it", "one", "", "", "")]


def rows_of(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect())


@pytest.mark.parametrize(("min_docs", "top", "growth"), [(3, 200, 8), (3, 5, 2), (1, 3, 2), (2, 1, 3)])
def test_audit_against_integers(spark, monkeypatch, min_docs, top, growth):
    monkeypatch.setattr(divergence, "GROWTH", growth)
    rows = corpus(4, 260)
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), Scratch(spark, "t"), min_docs, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["rank"] == "int"
    assert rows_of(got) == expected(rows, min_docs, top)


def test_small_tables_of_counts_and_pairs(spark, monkeypatch):
    """Tasks hand on their counts often, texts come in slices, and a term's pairs in stretches."""
    monkeypatch.setattr(divergence, "ENTRIES", 11)
    monkeypatch.setattr(divergence, "SLICE", 16)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = corpus(5, 120) + [(7, "longterm" * 40 + " alpha " * 30, "en", "b", "", "", "")] * 3
    assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))) == expected(rows)


def test_slices_hold_whole_terms(monkeypatch):
    text = ("äb cd, efghijklmnopqrstuvwxyz " * 50 + "x" * 200 + " end").encode()
    want = text.translate(divergence.TABLE).split()
    for size in (1, 5, 16, 64, 10_000):
        monkeypatch.setattr(divergence, "SLICE", size)
        assert [w for part in divergence.words(text) for w in part] == want
    assert list(divergence.words(b"")) == [[]]


def test_search_stops_early(spark):
    """One term stands out; buckets of small bounds are never evaluated."""
    rows = [(i, " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(300)) + (" big" * 50 if i % 2 else ""), "en", f"s{i % 2}", "", "", "") for i in range(12)]
    scratch = Scratch(spark, "t")
    audit = divergence.Audit(spark.createDataFrame(rows, SCHEMA), scratch)
    assert {(r.source, r.item) for r in audit.terms(top=1).collect()} == {("s1", "big"), ("s0", "waa")}


def test_overlong_values_and_no_rows(spark):
    got = divergence.divergence(spark.createDataFrame([], SCHEMA), Scratch(spark, "t"))
    assert got.count() == 0
    rows = [(i, "a " * 200_000 + "b", "en", "s", "", "", "") for i in range(3)] + [(9, None, "en", "t", "", "", "")]
    assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA), Scratch(spark, "t"))) == expected(rows)
