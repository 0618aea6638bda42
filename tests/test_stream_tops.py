"""Layer tops on a stream: rows of a survey over several batches and out of order give the answer of the batch."""

import json
import random

import pytest

from stratalake.operators import layers
from stratalake.streaming import surveys

SCHEMA = "nr string, top double, bottom double, lith string, surface double, seen timestamp"
STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(STORE, before)


def test_rule_of_one_survey_is_that_of_tables(spark):
    rng, rows = random.Random(4), []
    for nr in range(60):
        z = 0.0
        for _ in range(rng.randint(0, 12)):
            t = rng.randint(1, 8) / 4
            rows.append((str(nr), z, z + t, rng.choice("ZZVK"), 0.0, None))
            z += t
    df = spark.createDataFrame(rows, SCHEMA)
    for rule in ((None, None), (1.5, None), (2.0, 0.75), (1.0, 0.5)):
        want = {r.nr: r.top for r in layers.layer_top(df, "lith", "Z", *rule).collect()}
        for nr in {r[0] for r in rows}:
            assert surveys.first_top([(t, b, x == "Z") for n, t, b, x, *_ in rows if n == nr], *rule) == want.get(nr)


def test_five_batches_out_of_order(rocks, tmp_path):
    spark, rng = rocks, random.Random(7)
    rows = [(f"s{nr}", i / 2, (i + 1) / 2, rng.choice("ZVK"), 0.0) for nr in range(8) for i in range(10)]
    (tmp_path / "in").mkdir()
    left = rows[:]
    rng.shuffle(left)
    batches = [left[i::5] for i in range(5)] + [[("end", 0.0, 1.0, "V", 0.0)], [("end", 1.0, 2.0, "V", 0.0)]]
    for i, batch in enumerate(batches):
        seen = f"2024-01-01T0{i if i < 5 else i + 3}:00:00Z"
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("nr", "top", "bottom", "lith", "surface", "seen"), (*r, seen)))) for r in batch))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    tops = surveys.layer_tops(stream, "lith", ["Z"], "seen", "90 minutes", min_thickness=1.0, min_fraction=0.5)
    query = tops.writeStream.format("memory").queryName("tops").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got = {r.nr: r.top for r in spark.table("tops").collect()}
    df = spark.createDataFrame([(*r, None) for r in rows], SCHEMA)
    assert got == {r.nr: r.top for r in layers.layer_top(df, "lith", "Z", 1.0, 0.5).collect()} and len(got) > 3
