import itertools
from fractions import Fraction

from stratalake.llm import mixing, urls
from stratalake.llm.common import Scratch

DOCS = "doc_id long, text string, source string, size string, u double"


def test_quotas_stop_at_their_limit():
    got = mixing.quotas({"a": 100, "b": 10, "é": 10, None: 80})
    assert sum(got.values()) == Fraction(300) and got["b"] == 20 and got["é"] <= 20
    assert got["a"] / got[None] == 1 or got["a"] == 200 or got["a"] / got[None] == Fraction(5, 5)
    assert mixing.quotas({}) == {} and mixing.quotas({"a": 0}) == {"a": 0}


def test_flow_prefers_first_uses_and_shares():
    flow = mixing.min_cost_flow({"x": 10, "xy": 10, "y": 10}, {"x": ("X",), "xy": ("X", "Y"), "y": ("Y",)}, {"X": 20, "Y": 15})
    used = {k: sum(v) for k, v in flow.items()}
    assert used["x", "X"] + used["xy", "X"] == 20 and used["xy", "Y"] + used["y", "Y"] == 15
    assert sum(v[1] for v in flow.values()) == 5  # 35 wanted of 30


def test_mix(spark):
    rows = [(i, "w " * (20 + i % 17), f"s{i % 4}" if i % 9 else None) for i in range(400)] + [(500, None, "s0"), (501, "", "s1"), (3, "w w", "s2"), (None, "w w w", "s3")]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    got = mixing.mix(df, Scratch(spark, "t")).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    goal = mixing.quotas(sizes)
    source = {d: s for d, _, s in rows if d not in (3, None)}
    taken: dict = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken % max(1, r.size) == 0
        if r.doc_id in source:
            s = source[r.doc_id]
            taken[s] = taken.get(s, 0) + r.taken
            assert r.source_size == sizes[s] and abs(r.target - float(goal[s])) < 1e-9
    assert all(abs(taken[s] - goal[s]) <= 80 for s in sizes)
    again = mixing.mix(df.repartition(7), Scratch(spark, "t")).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    out = mixing.take(df, Scratch(spark, "t"))
    assert out.columns == df.columns and out.count() == sum(r.taken // r.size for r in got if r.size)
    assert mixing.mix(df.limit(0), Scratch(spark, "t")).count() == 0


def test_mix_over_several_buckets(spark, monkeypatch):
    """taken against running sums in Python, in the order of the same hash; one doc_id has many rows."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    rows = [(i if i % 5 else 77, "w " * (20 + i % 17) + f"x{i}", f"s{i % 3}") for i in range(300)] + [(None, f"null {i}", "s1") for i in range(40)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], DOCS)
    got = sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(df, Scratch(spark, "t")).collect())
    told = df.select("doc_id", "text", "source", mixing.text_hash())
    placed = told.selectExpr("doc_id", "size(split(text, ' ')) as n", "text", "source", f"shiftrightunsigned(xxhash64({mixing.SEED}, doc_id, spread), 33) as u").collect()
    assert max(map([(r.source, r.u * 40 >> 31) for r in placed].count, {(r.source, r.u * 40 >> 31) for r in placed})) < 20
    want, total = [], sum(len(t.split()) for _, t, _ in rows)
    order, weights = ["s0", "s1", "s2"], [5, 2, 1]
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in order}
    left, open_, goal = Fraction(3, 2) * total, dict(zip(order, weights)), {}
    while full := [s for s in open_ if left * open_[s] / sum(open_.values()) > 2 * size[s]]:
        for s in full:
            goal[s] = 2 * size[s]
        left -= sum(2 * size[s] for s in full)
        for s in full:
            del open_[s]
    goal |= {s: left * w / sum(open_.values()) for s, w in open_.items()}
    for s in order:
        need, at = int(goal[s] + Fraction(1, 2)), 0
        reach = [min(need, size[s]), max(0, need - size[s])]
        for r in sorted((r for r in placed if r.source == s), key=lambda r: (r.u, r.doc_id is not None, r.doc_id or 0)):
            n = len(r.text.split())
            want.append((str(r.doc_id), n, n * sum(x > 0 and 2 * at + n <= 2 * x for x in reach)))
            at += n
    assert got == sorted(want)


def test_mined_rules_equal_brute_force(spark):
    import random

    r = random.Random(3)
    baskets = []
    for _ in range(300):
        have = {t for t in "abcdefg" if r.random() < 0.35}
        block = {"a", "b"} <= have or "c" in have and r.random() < 0.9
        baskets.append((sorted(have), "block" if block else "allow"))
    baskets += [(["a", "b"], "block")] * 20 + [([], "allow"), (["z"], "block")]
    count: dict = {}
    for have, label in baskets:
        for k in range(1, len(have) + 1):
            for key in itertools.combinations(have, k):
                for x in (None, label):
                    count[key, x] = count.get((key, x), 0) + 1
    least = -(-len(baskets) * 5 // 100)
    sure = {(k, x): n / count[k, None] for (k, x), n in count.items() if x and n >= least}
    want = []
    for (key, x), c in sure.items():
        parts = [sure.get((p, x), 0) for k in range(1, len(key)) for p in itertools.combinations(key, k)]
        if c >= 0.8 and all(c > p for p in parts):
            want.append((key, x, round(c, 9), round(count[key, x] / len(baskets), 9)))
    df = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    got = [(k, x, round(c, 9), round(s, 9)) for k, x, c, s in urls.mine(df, 0.05, 0.8).rules]
    assert sorted(got) == sorted(want) and any(len(k) > 1 for k, *_ in got)


def test_overlapping_sources(spark):
    rows = [(i, 10, ["a"] if i % 3 == 0 else ["b"] if i % 3 == 1 else ["b", "a"]) for i in range(90)] + [(100, 5, []), (101, 5, None)]
    df = spark.createDataFrame(rows, "doc_id long, size long, members array<string>")
    got = {r.doc_id: r for r in mixing.choose(df, Scratch(spark, "t")).collect()}
    assert got[100].taken == got[101].taken == 0
    assert abs(sum(r.taken for r in got.values()) - 1350) <= 30


def test_url_rules(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?q=1", "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "http://x.net/de/", "x.net", "/de/", "net/", "block"),
        (3, "https://net", "net", "", None, None),
        (4, "https://example.com/de/1#f", "example.com", "/de/1", "example.com/de/", "block"),
        (5, "https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
        (6, "https://q.org/fr/?a://b", "q.org", "/fr/", "org/fr/", "allow"),
        (7, None, "", "", None, None),
        (8, "no scheme", "", "", None, None),
        (9, "ftp://h?x", "h", "", None, None),
        (1, "http://A.Example.NET/en/x?q=1", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "t") for r in rows], "page_id long, url string, tokens string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    for page_id, _, host, path, rule, verdict in rows:
        r = got[page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict if verdict else r.verdict in ("allow", "block")
    assert got[7].verdict == "allow"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_mined_rules(spark):
    spam = [(["h:casino", "p:win", f"p:{i}"], "block") for i in range(40)]
    good = [(["h:wiki", "p:win" if i % 2 else "p:page", f"p:{i}"], "allow") for i in range(60)]
    rules = urls.mine(spark.createDataFrame(spam + good, "tokens array<string>, verdict string"), 0.05, 0.8)
    best = {key: verdict for key, verdict, *_ in rules.rules}
    assert best[("h:casino",)] == "block" and best[("h:wiki",)] == "allow" and ("p:win",) not in best
    index = urls.RuleIndex(rules)
    assert index.best(["h:casino", "x"])[1] == "block" and index.best(["nothing"]) is None


def test_url_rules_are_all_the_irredundant_ones(spark):
    four = [(["a", "b", "c", "d"], "block")] * 40 + [([x for x in "abcd" if x != out], "allow") for out in "abcd" for _ in range(40)]
    mixed = [([f"t{k}" for k in range(7) if (i * 37 + i // 5) >> k & 1], "block" if i * 37 % 11 < 5 or i % 16 > 11 else "allow") for i in range(300)]
    for rows in (four, mixed):
        rows = [(t, v) for t, v in rows if t]
        names = sorted({x for t, _ in rows for x in t})
        keys = [frozenset(k) for n in range(1, len(names) + 1) for k in itertools.combinations(names, n)]
        count = {(k, v): sum(k <= set(t) and v in (w, None) for t, w in rows) for k in keys for v in (None, "block", "allow")}
        sure = {(k, v): count[k, v] / count[k, None] for k in keys for v in ("block", "allow") if count[k, v] >= 0.02 * len(rows)}
        want = {(tuple(sorted(k)), v): c for (k, v), c in sure.items() if c >= 0.6 and not any(s < k and w == v and d >= c for (s, w), d in sure.items())}
        got = {(k, v): c for k, v, c, _ in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.6).rules}
        assert got == want
        assert any(len(k) > 3 for k, _ in got)


def test_long_urls_and_ties(spark):
    long = "http://a.net/" + "x" * 100_000 + "?" + "&".join(f"q{i}=1" for i in range(2000))
    rows = [(1, long), (2, "http://b.de/p/q?id=1"), (2, "http://b.de/p/q?id=1"), (3, "http://"), (4, "no scheme"), (5, "http://c.org/fr/"), (None, "http://d.net/")]
    got = sorted((str(r.page_id), r.host, len(r.path), r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect())
    assert got[0] == ("1", "a.net", 100_001, "net/", "block") and got[1][:3] == got[2][:3] == ("2", "b.de", 4) and got[1] == got[2]
    assert got[3][1:3] == ("", 0) and got[4][1:3] == ("", 0) and got[5][3:] == ("org/fr/", "allow") and got[6][3] == "net/"


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "MAX_PATTERNS", 5)
    df = spark.createDataFrame([(i, 10, [f"s{i}"]) for i in range(6)], "doc_id long, size long, members array<string>")
    with pytest.raises(ValueError, match="patterns"):
        mixing.choose(df, Scratch(spark, "t"))
    assert mixing.choose(df.limit(5), Scratch(spark, "t")).count() == 5


def test_tokens_of_the_same_urls_are_one_class(spark):
    rows = [([*(f"q{i}" for i in range(300)), "shared"], "block")] * 40 + [(["shared", "other", *(f"r{i}" for i in range(60))], v) for v in ("block", "allow") for _ in range(20)]
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.02, 0.8)
    assert [r[0] for r in found.rules] == [("q0",)] and found.classes["q77"] == "q0" and found.classes["r5"] == "other"
    index = urls.RuleIndex(found)
    assert index.best(["q123", "x"]) == (0, "block") and index.text(0, ["q123", "x", "q9"]) == "q123" and index.best(["other"]) is None


def test_wide_urls_need_more_support_for_combinations(spark, monkeypatch):
    import random

    r = random.Random(8)
    monkeypatch.setattr(urls, "WIDEST", 8)
    rows = [([f"t{k}" for k in range(60) if r.random() < (0.6 if k < 6 else 0.12)], r.choice(["block", "allow"])) for _ in range(400)]
    rows = [(t, "block" if {"t0", "t1", "t2"} <= set(t) else v) for t, v in rows]
    found = urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.01, 0.9)
    best = {k: (v, c) for k, v, c, _ in found.rules}
    assert best[("t0", "t1", "t2")] == ("block", 1.0) and all(len(k) <= 8 for k in best)


def all_rules(rows, min_support, min_confidence):
    """Rules by all frequent sets, level by level, without any that has a part as sure."""
    least, found = -(-int(min_support * 1000) * len(rows) // 1000), {}
    names = sorted({t for have, _ in rows for t in have})
    bits = {n: sum(1 << i for i, (have, _) in enumerate(rows) if n in have) for n in names}
    for label in ("block", "allow"):
        own = sum(1 << i for i, (_, v) in enumerate(rows) if v == label)
        level, best = {(): (1 << len(rows)) - 1}, {(): -1}
        while level:
            level = {(*k, n): b & bits[n] for k, b in level.items() for n in names if not k or n > k[-1]}
            level = {k: b for k, b in level.items() if (b & own).bit_count() >= least}
            for k, b in level.items():
                sure = (b & own).bit_count() / b.bit_count()
                part = max(best[k[:i] + k[i + 1 :]] for i in range(len(k)))
                best[k] = max(sure, part)
                if sure >= min_confidence and sure > part:
                    found[k, label] = (sure, (b & own).bit_count() / len(rows))
    return found


def test_wide_urls_lose_no_rule(spark):
    import random

    r = random.Random(1)
    rows = [(["a", "b"], "block")] * 40 + [([t], "allow") for t in "ab" for _ in range(40)] + [([f"z{i}"], "allow" if i % 2 else "block") for i in range(3300)]
    rows += [([f"w{k:02}" for k in range(40) if r.random() < 0.7], r.choice(["block", "allow"])) for _ in range(62)]
    got = {(k, v): (c, s) for k, v, c, s in urls.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.005, 0.8).rules}
    assert got[("a", "b"), "block"] == (1.0, 40 / len(rows))
    # Each token of one row only is below the support.
    assert got == all_rules([([t for t in have if t[0] != "z"], v) for have, v in rows], 0.005, 0.8) and max(len(k) for k, _ in got) > 3


def test_grown_rules_equal_brute_force_over_rounds(spark, monkeypatch):
    import random

    r = random.Random(7)
    names = [f"t{k:02}" for k in range(25)]
    rows = [([n for n in names if r.random() < 0.3], r.choice(["block", "allow"])) for _ in range(400)]
    rows = [(t, "block" if {"t00", "t01"} <= set(t) else v) for t, v in rows] + [(names, v) for v in ("block", "allow") for _ in range(3)]
    want = all_rules(rows, 0.02, 0.7)
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    for most in (urls.GROWN, 20):
        monkeypatch.setattr(urls, "GROWN", most)
        assert {(k, v): (c, s) for k, v, c, s in urls.mine(df, 0.02, 0.7).rules} == want
    assert {v for _, v in want} == {"block", "allow"} and max(len(k) for k, _ in want) > 3


def test_grown_rules_are_those_of_fp_growth(spark, monkeypatch):
    import random

    r = random.Random(2)
    rows = [([f"t{k}" for k in range(9) if r.random() < 0.6], r.choice(["block", "allow", "allow"])) for _ in range(200)] * 3
    rows += [([], "allow"), (None, "block"), (["t0", "t0", "t1"], "block")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    want = urls.mine(df, 0.02, 0.7)
    monkeypatch.setattr(urls, "WIDEST", 0)
    assert urls.mine(df, 0.02, 0.7) == want and any(len(r[0]) > 3 for r in want.rules)
    one = urls.mine(df.where("verdict = 'allow'"), 0.02, 0.7)
    assert {v for _, v, *_ in one.rules} == {"allow"} and urls.mine(df.limit(0)).rules == []


def test_equal_rows_are_one_of_a_bucket(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    same = spark.range(100_000).selectExpr("7L as doc_id", "'a b c' as text", "'s0' as source", "'' as size", "0D as u")
    rest = spark.range(300).selectExpr("id as doc_id", "concat('w ', id) as text", "concat('s', id % 2) as source", "'' as size", "0D as u")
    scratch = Scratch(spark, "t")
    df = same.union(rest)
    got = mixing.mix(df, scratch)
    assert got.count() == 100_300
    placed = spark.read.parquet(scratch.path("placed")).groupBy("key", "bucket").count()
    assert placed.agg({"count": "max"}).first()[0] <= 100
    by = {(r.source_size, r.target): r.taken for r in got.groupBy("source_size", "target").sum("taken").withColumnRenamed("sum(taken)", "taken").collect()}
    assert len(by) == 2 and all(abs(v - k[1]) <= 3 for k, v in by.items())
    out = mixing.take(df, Scratch(spark, "t"))
    words = out.selectExpr("source", "size(split(text, ' ')) as n").groupBy("source").sum("n").collect()
    assert all(abs(r[1] - t) <= 3 + 0.02 * t for r, t in zip(sorted(words), sorted((k[1] for k in by), reverse=True)))


def test_take_is_the_mix(spark):
    rows = [(i % 90 if i % 7 else None, f"{'w ' * (3 + i % 11)}x{i % 60}", f"s{i % 3}" if i % 10 else None, "", 0.0) for i in range(500)] + [(5, None, "s1", "", 0.0), (6, "", None, "", 0.0)]
    df = spark.createDataFrame(rows, DOCS)
    mixed = mixing.mix(df, Scratch(spark, "t")).where("taken > 0").selectExpr("doc_id", "size", "taken div size as times")
    want = sorted(str((r.doc_id, r["size"])) for r in mixed.collect() for _ in range(r.times))
    out = mixing.take(df, Scratch(spark, "t"))
    got = sorted(str((r.doc_id, len(r.text.split()))) for r in out.collect())
    assert out.columns == df.columns and abs(len(got) - len(want)) <= 4
    from collections import Counter

    differ = Counter(got) - Counter(want)
    assert sum(differ.values()) <= 4  # equal rows at a cut are left by chance
    assert mixing.take(df.limit(0), Scratch(spark, "t")).count() == 0
