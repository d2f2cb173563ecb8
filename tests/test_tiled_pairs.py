"""Pairs of large blocks, tested in arrays, against those of a plain join."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import groups as G
from lodestone.sources import assets as A
from tests.test_pair_counts import odd_rows


def plain(pairs):
    return sorted((r.block, r.src, r.dst, r.distance) for r in pairs.select("block", "src", "dst", "distance").collect())


@pytest.mark.parametrize("sensitivity", ["conservative", "balanced", "aggressive"])
@pytest.mark.parametrize("odd", [True, False])
def test_large_blocks_equal_a_join(spark, monkeypatch, sensitivity, odd):
    near = F.col("asset_id") % 3 == 0  # some with few bits apart, some vectors of two sizes
    rows = odd_rows(spark, 120, 6).withColumn("hash", F.when(near, F.col("hash") % 1024).otherwise(F.col("hash")))
    vector = F.when(F.col("asset_id") % 4 == 0, F.array(F.col("asset_id") / 200.0, F.lit(0.1))).when(F.col("asset_id") % 7 == 0, F.array(F.lit(None).cast("double")))
    rows = rows.withColumn("feature", vector) if odd else G.with_block(A.derive_assets(spark, "/root/testdata/sf0.001").where("asset_id < 400"))
    rows = rows.cache()
    want = plain(G.judged(G.block_pairs(rows, G.PAIR, G.cheap_test(sensitivity)), sensitivity))
    monkeypatch.setattr(G, "TILE", 2)
    found = G.accepted_pairs(rows, sensitivity)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert len(want) > 20 and plain(found) == want


def test_undated_pairs_are_no_rows_of_a_join(spark, monkeypatch):
    """Of a large block only pairs that passed the cheap tests become rows, and those settled carry nothing else."""
    monkeypatch.setattr(G, "TILE", 2)
    rows = G.with_block(A.derive_assets(spark, "/root/testdata/sf0.001")).where("capture_ts is null")
    pairs = G.tiled_pairs(rows, G.large_blocks(rows.select(F.col("block").alias("__block")), 2), "aggressive")
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString().replace("LeftOuter", "").split("MapInArrow")[0]
    seen = pairs.agg(F.count(F.lit(1)).alias("n"), F.count("settled").alias("s"), F.count("a_hash").alias("h")).first()
    assert seen.n == seen.s > 0 and seen.h == 0
