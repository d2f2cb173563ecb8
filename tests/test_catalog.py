"""Catalog queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from lodestone.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return "None"
        return f"{float(v):.6f}" if isinstance(v, (int, float)) and not isinstance(v, bool) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)

    return sorted(tuple(plain(v) for v in r) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in os.listdir(SF):
        out.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return out


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_pairs_are_hash_joins_and_scans_are_pruned(spark):
    from lodestone.operators import groups as G
    from lodestone.sources.assets import derive_assets

    plan = G.accepted_pairs(G.with_block(derive_assets(spark, SF)), "balanced")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_costly_tests_run_behind_the_join(spark):
    from lodestone.operators import groups as G
    from lodestone.sources.assets import derive_assets

    found = G.accepted_pairs(G.with_block(derive_assets(spark, SF)), "aggressive")
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("forall" in line for line in joins)
    assert "ReusedExchange" in plan or "ReusedQueryStage" in plan or "BroadcastHashJoin" in plan
