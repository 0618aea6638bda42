import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from stratalake.llm import conversations
from stratalake.llm.common import Scratch
from stratalake.llm.queries import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string, copy string, digest string, facts string"
SPACES = " \t\n\x0b\x0c\r"


def brute(symbols):
    """Least (cost, audit) over all edits with up to two insertions in each place; symbols as in a signature."""
    best = None
    for gaps in itertools.product(range(3), repeat=len(symbols) + 1):
        if best and 3 * sum(gaps) > best[0]:
            continue
        for letters in itertools.product("DKR", repeat=len(symbols)):
            cost, audit, made = 3 * sum(gaps), "I" * gaps[0], ["?"] * gaps[0]
            for s, letter, n in zip(symbols, letters, gaps[1:]):
                if s == "d" and letter != "D":
                    break
                cost += {"D": 4, "K": 0, "R": 3}[letter] + 3 * (letter != "D" and s.isupper())
                audit += letter + "I" * n
                made += ([] if letter == "D" else [s.lower() if letter == "K" else "?"]) + ["?"] * n
            else:
                if best and (cost, audit) >= best:
                    continue
                shift = 1 if made[:1] == ["s"] else 0
                fits = all(m in ("?", "ua"[i % 2]) for i, m in enumerate(made[shift:]))
                if fits and len(made[shift:]) % 2 == 0 and (len(made) != 1):
                    best = cost, audit
    return best


def test_layers_against_all_edits():
    rng = random.Random(1)
    found = {"".join(p) for n in range(4) for p in itertools.product("suaxdU", repeat=n)} | {"".join(rng.choice("suaxdSUAX") for _ in range(4)) for _ in range(120)}
    trie = conversations.Trie()
    for s in sorted(found):
        assert trie.insert(s) == brute(s), s
    # A layer is made once for a shared prefix, whatever the number of signatures below it.
    assert trie.layers == len({s[:i] for s in found for i in range(1, len(s) + 1)})


def test_long_signatures_share_a_path():
    trie = conversations.Trie()
    base = "s" + "ua" * 100_000
    assert trie.insert(base) == (0, "K" * len(base))
    assert trie.insert(base + "u") == (3, "K" * (len(base) + 1) + "I")
    assert trie.layers == len(base) + 1 and len(trie.known) < 30


def expected(rows):
    """The whole contract in plain Python; rows of (conv, turn, role, text), no two of one turn differ."""
    out, convs = {}, defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(kind, text)
        convs[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in found:
            bare = text.strip(SPACES)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in found if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(found, found[1:])]
        signature = [("d" if f in ("blank", "duplicate") else (s := r[:1] if r[:1] in ("s", "u", "a") and r else "x") and (s.upper() if f else s)) for (_, r, _), f in zip(found, faults)]
        cost, audit = brute(signature)
        parts, at = [], 0
        for letter in audit:
            _, role, text = found[at] if letter != "I" else (0, "", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter != "K":
                last = parts[-1][0][:1] if parts else ""
                role = "assistant" if last == "u" else "user"
            parts.append((role, "" if letter == "I" else text))
        text = "\n".join(f"{r}:{t}" for r, t in parts)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def odd_rows():
    rng, rows = random.Random(3), []
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "usher", "Ünter"]
    bodies = ["Yes.", "No!", "cut off", "", None, " \t", "é?", "x. ", "Why?\n", " ", "a.b"]
    for conv in range(160):
        for turn in sorted(rng.sample(range(9), rng.randint(0, 4))):
            rows.append((conv, turn, rng.choice(roles), rng.choice(bodies), "c", "d", "f"))
    rows += [(None, 1, "user", "Hi.", "", "", ""), (None, 2, "assistant", "Ho.", "", "", ""), (900, None, "user", "Hm.", "", "", ""), (901, 5, None, None, "", "", "")]
    rows += [(902, 1, "user", "Same.", "", "", "")] * 3  # repeated rows
    drop = next(i for i in range(10_000, 20_000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return [*rows, (drop, 0, "user", "Gone.", "", "", "")], drop


def test_repair_against_the_rules(spark):
    rows, drop = odd_rows()
    got = conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA).repartition(7)), Scratch(spark, "t")).collect()
    want = expected(rows)
    assert {r.conv_id: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert want[drop] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_sql_gives_the_same(spark):
    rows, _ = odd_rows()
    got = conversations.repair(conversations.damage(spark.createDataFrame(rows, SCHEMA)), Scratch(spark, "t"))
    db = duckdb.connect()
    db.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    db.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    assert sorted(map(str, db.execute(ORACLE["op12_conversation_repair"]).fetchall())) == sorted(str(tuple(r)) for r in got.collect())


def test_one_conversation_with_most_rows(spark):
    n = 30_000
    rows = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat('text ', id, '.') as text")
    got = conversations.repair(conversations.rows_of(rows.repartition(6)), Scratch(spark, "t")).first()
    text = "\n".join(f"{'assistant' if i % 2 else 'user'}:text {i}." for i in range(n))
    assert got.cost == 0 and got.audit == "K" * n and got.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("kind", ["string", "int"])
def test_no_rows_and_other_keys(spark, kind):
    schema = f"conv_id {kind}, turn int, role string, text string"
    assert conversations.repair(conversations.damage(spark.createDataFrame([], schema)), Scratch(spark, "t")).count() == 0
    row = ("a" if kind == "string" else 5, 1, "user", "x" * 3_000_000)
    got = conversations.repair(conversations.rows_of(spark.createDataFrame([row], schema)), Scratch(spark, "t")).first()
    assert got.conv_id == row[0] and got.audit == "D" and got.cost == 4  # cheaper than to answer it and leave it cut off
