import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    words = lambda i, n=80: [f"w{(i * 31 + j * 17) % 997}x{j}" for j in range(n)]
    clean = [(i, " ".join(words(i)), "en", f"s{i % 3}", 1) for i in range(260)]
    item = " ".join(f"item{j}" for j in range(14))
    more = [
        (1000, clean[5][1], "en", "s1", 1),  # exact copy
        (1001, clean[6][1] + " tail", "en", "s1", 1),  # near copy
        (1002, clean[7][1] + " " + item, "en", "s1", 1),  # both a near copy and a leak
        (1003, " ".join(words(500)) + " " + item, "en", "s1", 1),  # leak
        (1004, " ".join(words(501)) + " ###" * 60, "en", "s0", 1),  # junk
        (1005, "short text", "en", "s0", 1),
        (1006, None, None, None, None),
        (9, clean[9][1], "en", "s0", 1),  # repeated row
    ]
    docs = spark.createDataFrame(clean + more, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
        ids.append(sorted(r.doc_id for r in now.select("doc_id").collect()))
    good = list(range(260))
    assert ids[0] == sorted([*good, 9, 1000, 1001, 1002, 1003])
    assert set(ids[1]) - {1003} <= set(good) and ids[1] == sorted({*good, 1003})
    assert ids[2] == good
    assert set(ids[3]) <= set(good) and max(map(ids[3].count, good)) == 2
    out = corpus_pipeline.run(spark, str(tmp_path))
    seen = {d for r in out.collect() for d in r.doc_ids}
    assert seen == set(ids[3]) and sorted(r.slot for r in out.collect()) == list(range(out.count()))


def write(spark, path, docs, schema, items=()):
    spark.createDataFrame(docs, schema).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(list(items), "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def test_empty_documents(spark, tmp_path):
    sf = write(spark, tmp_path, [], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, sf).count() == 0


def test_empty_benchmark_and_clashing_columns(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 31 + j * 17) % 997}x{j}" for j in range(80))
    schema = "doc_id long, text string, lang string, source string, row string, size string, members string, words string, node string, key string, u string, n_words string, kept string"
    rows = [(i, text(i), "en", "s", *("abcdefghi"[k] * 2 for k in range(9))) for i in range(30)] + [(31, text(5), "en", "s", *["zz"] * 9)]
    sf = write(spark, tmp_path, rows, schema)
    now, columns = spark.read.parquet(f"{sf}/documents.parquet"), None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, now, sf)
        columns = columns or out.columns
        assert out.columns == columns == [c.split()[0] for c in schema.split(", ")]
        out.write.parquet(str(tmp_path / f"out{i}"))
        now = spark.read.parquet(str(tmp_path / f"out{i}"))
    kept = [tuple(r) for r in now.collect()]
    assert set(kept) <= set(rows) and {r[0] for r in kept} <= set(range(30)) and len(set(kept)) > 20
    assert {d for r in corpus_pipeline.run(spark, sf).collect() for d in r.doc_ids} == {r[0] for r in kept}


def test_stages_leave_no_texts(spark, tmp_path):
    from pathlib import Path

    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:").replace("//", "/")) / "stratalake"
    before = set(root.glob("pipeline-*")) if root.exists() else set()
    sf = write(spark, tmp_path, [(i, " ".join(f"w{(i * 31 + j * 17) % 997}x{j}" for j in range(80)), "en", "s", 1) for i in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
    manifest = corpus_pipeline.run(spark, sf)
    left = {p.name.rsplit("-", 1)[0] for p in set(root.glob("pipeline-*")) - before if any(p.rglob("*.parquet")) or any(p.rglob("*.bin"))}
    assert "pipeline-order" in left
    tables = [f.parent for p in set(root.glob("pipeline-*")) - before if not p.name.startswith("pipeline-order") for f in p.rglob("*.parquet") if "stage-" not in f.parent.name]
    assert tables and not any({"row", "text", "_text"} & set(spark.read.parquet("/" + str(t).lstrip("/")).columns) for t in tables)
    assert all(Path(r.path.removeprefix("file:").replace("//", "/")).exists() for r in manifest.select("path").distinct().collect())


def some_documents(n=120):
    text = lambda i: " ".join(f"w{(i * 31 + j * 17) % 997}x{j}" for j in range(80))
    return [(i, text(i), "en", f"s{i % 3}", 1) for i in range(n)] + [(900, text(5), "en", "s0", 1), (901, "short", "en", "s1", 1)]


def test_results_stay_readable_when_other_stages_run(spark, tmp_path):
    sf = write(spark, tmp_path, some_documents(), "doc_id long, text string, lang string, source string, n_chars long", [(1, "a b c d e f g h i j k")])
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    results = [stage(spark, docs, sf) for _, stage in corpus_pipeline.STAGES[:-1]]
    again = [stage(spark, docs, sf) for _, stage in corpus_pipeline.STAGES[:-1]]
    counts = [r.count() for r in results]
    assert counts == [r.count() for r in again] == [r.count() for r in results]
    assert counts[:3] == [121, 121, 122] and results[0].where("doc_id = 901").count() == 0


def test_two_pipelines_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, n in (("a", 120), ("b", 90)):
        (tmp_path / name).mkdir()
        write(spark, tmp_path / name, some_documents(n), schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda name: corpus_pipeline.run(spark, str(tmp_path / name)), "ab"))
    alone = [corpus_pipeline.run(spark, str(tmp_path / name)) for name in "ab"]
    slots = lambda df: sorted((r.slot, r.n_tokens, r.doc_ids) for r in df.collect())
    for x, y in zip(both, alone):
        assert sorted(d for r in x.collect() for d in r.doc_ids) == sorted(d for r in y.collect() for d in r.doc_ids) and len(slots(x)) == len(slots(y))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
