"""Layer tops by running sums, against the rule worked out row by row."""

import random
from collections import defaultdict

import numpy as np
import pytest

from stratalake.operators import layers

SCHEMA = "nr int, top double, bottom double, lith string, surface double"


def surveys(seed, step):
    rng, rows = random.Random(seed), []
    for nr in range(40):
        z = 0.0
        for _ in range(rng.randint(0, 25)):
            thick = rng.randint(1, 12) * step
            rows.append((nr, z, z + thick, rng.choice("ZZVKG") if rng.random() > 0.05 else None, 1.0))
            z += thick + (step * rng.randint(1, 4) if rng.random() < 0.15 else 0)
    return rows


def first_top(rows, wanted, reach, fraction, close):
    """The rule: rows whose top lies in the reach count, the last of them is cut off at its end."""
    for _, start, _, lith, _ in rows:
        if lith not in wanted:
            continue
        inside = [r for r in rows if start <= r[1] < start + reach]
        lengths = [(min(r[2], start + reach) if r is inside[-1] else r[2]) - r[1] for r in inside]
        share = sum(n for n, r in zip(lengths, inside) if r[3] in wanted) / reach
        if share > fraction or close(share, fraction):
            return start
    return None


@pytest.mark.parametrize("step", [0.125, 0.1])
@pytest.mark.parametrize(("reach", "fraction"), [(1.0, 0.5), (2.0, 0.75), (0.5, 1.0), (30.0, 0.3)])
def test_top_of_sand(spark, step, reach, fraction):
    rows = surveys(3, step)
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    got = {r.nr: r.top for r in layers.top_of_sand(spark.createDataFrame(rows, SCHEMA), fraction=fraction, reach=reach).collect()}
    want = {nr: first_top(g, ("Z", "G"), reach, fraction, lambda a, b: abs(a - b) < 1e-9) for nr, g in groups.items()}
    assert got == want and {v is None for v in want.values()} == {True, False}


@pytest.mark.parametrize(("reach", "fraction"), [(1.0, 0.5), (2.0, 0.75), (3.0, 1.0)])
def test_layer_top_with_disturbing_layers(spark, reach, fraction):
    rows = surveys(4, 0.125)
    groups = defaultdict(list)
    for nr, top, bottom, lith, s in rows:
        runs = groups[nr]
        if runs and (runs[-1][3] == "Z") == (lith == "Z"):
            runs[-1] = (nr, runs[-1][1], bottom, runs[-1][3], s)
        else:
            runs.append((nr, top, bottom, lith, s))
    got = {r.nr: r.top for r in layers.layer_top(spark.createDataFrame(rows, SCHEMA), "lith", "Z", min_thickness=reach, min_fraction=fraction).collect()}
    want = {nr: first_top(g, ("Z",), reach, fraction, np.isclose) for nr, g in groups.items()}
    assert got == {k: v for k, v in want.items() if v is not None}


def test_no_pairs_of_rows(spark):
    n = 20_000  # one dense survey: pairs within its reach would be 200 millions
    rows = spark.range(n).selectExpr("1 as nr", "id / 8D as top", "(id + 1) / 8D as bottom", "if(id % 7 < 4, 'Z', 'V') as lith", "0D as surface")
    got = layers.top_of_sand(rows, fraction=0.58, reach=n / 16)
    assert "Join" not in layers.share_below(rows.selectExpr("nr", "lith = 'Z' as ok", "top", "bottom"), "nr", 4.0)._jdf.queryExecution().executedPlan().toString()
    assert got.first().top is None and layers.top_of_sand(rows, fraction=0.57, reach=n / 16).first().top == 0.0


def test_rows_without_depths(spark):
    rows = [(1, None, 2.0, "Z", 0.0), (1, 0.0, None, "Z", 0.0), (2, None, None, None, None), (3, 1.0, 3.0, "Z", 0.0), (3, 1.0, 3.0, "Z", 0.0)]
    got = {r.nr: r.top for r in layers.top_of_sand(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: None, 2: None, 3: 1.0}
    assert layers.top_of_sand(spark.createDataFrame([], SCHEMA)).count() == 0
