"""Rows of a well packed file meet groups by a shuffle: their estimated size is that of the file."""

import pytest

from lodestone.operators import groups as G
from lodestone.sources.assets import derive_assets
from lodestone.sources.tables import cut

PLANS = {
    "block_pairs": lambda members, rows: G.block_pairs(rows, ["hash"]),
    "group_confidence": G.group_confidence,
    "placeholder_keeper": G.placeholder_keeper,
    "rank_groups": G.rank_groups,
    "cleanup_plan": lambda members, rows: G.cleanup_plan(cut(G.rank_groups(members, rows)), rows.selectExpr("asset_id", "pixel_count bytes")),
    "cleanup_stats": lambda members, rows: G.cleanup_stats(cut(G.rank_groups(members, rows)), rows),
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("packed"))
    spark.range(100_000).selectExpr("id event_id", "timestamp_ntz'2024-01-02 03:04:05' ts").write.parquet(f"{at}/events.parquet")
    return spark.range(100_000).selectExpr("id - id % 4 group_id", "id asset_id"), G.with_block(derive_assets(spark, at))


@pytest.mark.parametrize("name", PLANS)
def test_rows_are_not_broadcast(tables, name):
    assert tables[1].select("asset_id", "hash")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10 << 20
    plan = PLANS[name](*tables)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [__block" in plan if name == "block_pairs" else "SortMergeJoin [asset_id" in plan
    assert name.startswith("cleanup") or "BroadcastExchange" not in plan  # those join single rows
