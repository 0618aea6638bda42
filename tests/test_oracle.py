"""Catalogue queries against DuckDB over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from stratalake.plans import queries as plans

SF, SF_MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages".split()
#: Rare cases show in larger tables only: samples without any grains, units below all layers.
MORE = ["grain_percentiles", "grain_percentiles_sand", "voxel_boundary_join", "voxel_slice_grid_drop"]


@pytest.fixture(scope="module")
def dbs():
    out = {}
    for sf in (SF, SF_MORE):
        out[sf] = duckdb.connect()
        for t in TABLES:
            out[sf].execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return out


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    plain = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize(("sf", "name"), [*((SF, n) for n in plans.oracle_sql()), *((SF_MORE, n) for n in MORE)])
def test_query(spark, dbs, sf, name):
    got = plans.queries()[name](spark, sf)
    want = dbs[sf].execute(plans.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())
