"""Held-out figures by document, features and sizes against brute force."""

import math
import re
import zlib

import zstandard
from pyspark.sql import SparkSession

from stratalake.llm import langid, secrets

DOCS = "doc_id long, text string, lang string, source string"


def prose(i, n=80):
    return " ".join(("report water value system result " * 20).split()[j % 7] + str((i * 7 + j) % 13 or "") for j in range(n))


def test_findings_are_held_out_by_document(spark: SparkSession):
    docs = spark.createDataFrame([(i, prose(i), "en", f"s{i % 3}") for i in range(120)], DOCS)
    found = secrets.placed_findings(docs, 400)
    assert [f for f, _, _ in found] == secrets.planted_findings(docs, 400)
    learnt, tested = ({p for _, p, _ in found if (zlib.crc32(str(p).encode()) % 4 == 0) == held} for held in (False, True))
    assert learnt and tested and not learnt & tested
    said = secrets.held_out_by_kind(docs)
    kinds = {k for _, _, k in secrets.placed_findings(docs)}
    assert set(said) >= {"all", *kinds} and said["all"]["n"] == sum(said[k]["n"] for k in kinds)
    assert said["all"]["precision"] > 0.9 and said["all"]["recall"] > 0.9
    assert any(k.startswith("without ") for k in said) and all(v["n"] for v in said.values())


def test_features_by_hand():
    f = secrets.Features(["water", "report"])
    got = dict(zip(secrets.FEATURES, f.of("Ab3-water", 'my password = "', '" in commit', "tests/x")))
    text = "Ab3-water"
    assert (got["length"], got["digits"], got["upper"], got["symbols"]) == (9.0, 1 / 9, 1 / 9, 1 / 9)
    kinds = "uldslllll"
    assert got["transitions"] == sum(a != b for a, b in zip(kinds, kinds[1:])) / 8
    assert abs(got["entropy"] + sum(text.count(c) / 9 * math.log2(text.count(c) / 9) for c in set(text))) < 1e-12
    pairs, firsts = {}, {}
    for w in ("water", "report"):
        for a, b in zip(w, w[1:]):
            pairs[a + b], firsts[a] = pairs.get(a + b, 0) + 1, firsts.get(a, 0) + 1
    low = [a + b for a, b in zip(text.lower(), text.lower()[1:]) if a.isalpha() and b.isalpha()]
    surprise = -sum(math.log((pairs[p] + 0.5) / (firsts[p[0]] + 13)) if p in pairs else math.log(0.5 / 26) for p in low) / len(low)
    assert abs(got["surprise"] - surprise) < 1e-12 and got["coverage"] == 5 / 9 and got["hex"] == 0
    assert (got["keyword_before"], got["assigned"], got["quoted"], got["harmless_near"], got["test_path"], got["in_path"], got["pem"]) == (1, 1, 1, 1, 1, 0, 0)
    assert got["distinct"] == len(set(text)) / 9


def test_languages_by_zstandard_alone(spark):
    words = {"en": "the cat sat on a mat and the dog ran".split(), "fr": "le chat est sur la table et le chien".split()}
    rows = [(i, " ".join(words[k][(i * 3 + j * (i % 5 + 1)) % 9] for j in range(20 + i)), k, "s") for i in range(60) for k in (("en", "fr")[i % 2],)]
    rows += [(100, "le chat " * 400_000, None, None), (101, "the the the", "en", "s"), (101, "the the the", "en", "s"), (102, "", "en", "s"), (103, None, "fr", "s"), (104, "zzzz", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    learn = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    books = langid.dictionaries(spark.createDataFrame([(t, k) for _, t, k, _ in learn], "text string, lang string"))
    pieces = {k: sorted({t[max(0, (len(t) - langid.PIECE) // 2) :][: langid.PIECE] for _, t, x, _ in learn if x == k and t}) for k in ("en", "fr")}
    assert {k: sorted(v.decode().split("\n")) for k, v in books.items()} == pieces
    coders = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False) for k, v in books.items()}
    want = []
    for i, t, *_ in rows:
        if t is None or not re.search(r"[^\W\d_]", t):
            want.append((i, "und"))
            continue
        data = t.encode()
        size = {k: sum(len(c.compress(data[a : a + langid.CHUNK])) for a in range(0, len(data), langid.CHUNK)) for k, c in coders.items()}
        want.append((i, min(sorted(size), key=size.__getitem__)))
    got = langid.language_id(docs).collect()
    assert sorted((r.doc_id, r.lang_pred) for r in got) == sorted(want)
    assert all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.lang_pred == "und"} == {0.0}
