"""Groups that grow batch by batch against groups computed anew."""

import pytest

from lodestone.operators import groups as G
from lodestone.sources import assets as A
from lodestone.sources.tables import shared_path
from lodestone.streaming import growing
from lodestone.streaming.growing import GrowingGroups

SF = "/root/testdata/sf0.001"


def plain(rows, sensitivity):
    return sorted((r.group_id, r.asset_id) for r in G.group_members(rows, sensitivity).collect())


def stored(g):
    return sorted((r.group_id, r.asset_id) for r in g.members().collect())


@pytest.mark.parametrize(("sensitivity", "small"), [("balanced", False), ("aggressive", True)])
def test_equals_computing_anew(spark, monkeypatch, sensitivity, small):
    if small:  # tiles of the blocks, and a compaction on the way
        monkeypatch.setattr(growing, "COMPACT_AFTER", 2)
        monkeypatch.setattr(G, "TILE", 4)
        monkeypatch.setattr(G.cross_pairs, "__defaults__", (None, "block", 4))
    rows = G.with_block(A.derive_assets(spark, SF).where("asset_id < 300")).cache()
    g = GrowingGroups(spark, shared_path(spark, "growing"), rows.schema, sensitivity)
    assert stored(g) == []
    for i in range(3 if small else 5):
        part = rows.where(f"asset_id % 5 = {(2 * i) % 5}")
        assert g.add(part, i)
        assert stored(g) == plain(rows.where(f"asset_id % 5 in ({', '.join(str((2 * j) % 5) for j in range(i + 1))})"), sensitivity)
    assert not g.add(rows, i)  # sent again
    assert g.add(rows.where("asset_id < 30"), 99)  # stored assets stay
    assert stored(g) == plain(rows.where(f"asset_id % 5 in ({', '.join(str((2 * j) % 5) for j in range(i + 1))}) or asset_id < 30"), sensitivity)


def chain(spark, ids, block="b"):
    """Rows of one block in which neighbouring ids differ by few bits and others by many."""
    word = lambda i: sum(1 << b for b in range(64) if (b // 4 < i))
    data = [(i, block, (word(i) ^ 1 << 63) - (1 << 63), None, None, None, None, 0, [], None) for i in ids]
    return spark.createDataFrame(data, "asset_id long, block string, hash long, feature array<double>, capture_ts timestamp, lat double, lon double, face_count int, faceprints array<array<double>>, color_signature array<int>")


def test_merged_groups_are_renamed(spark):
    rows = chain(spark, range(16))
    g = GrowingGroups(spark, shared_path(spark, "growing"), rows.schema, "conservative")
    for i, ids in enumerate(([0, 1], [14, 15], [6], [8, 9, 10], [7, 11, 12, 13], [2, 3, 4, 5])):
        g.add(rows.where(rows.asset_id.isin(ids)), i)
        have = [x for part in ([0, 1], [14, 15], [6], [8, 9, 10], [7, 11, 12, 13], [2, 3, 4, 5])[: i + 1] for x in part]
        assert stored(g) == plain(rows.where(rows.asset_id.isin(have)), "conservative")


def test_only_touched_blocks_are_read(spark):
    rows = chain(spark, range(8)).unionByName(chain(spark, range(100, 108), "c"))
    g = GrowingGroups(spark, shared_path(spark, "growing"), rows.schema)
    g.add(rows, 0)
    read = g.touched(chain(spark, [9], "c").select("block"))
    assert {r.block for r in read.collect()} == {"c"}
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "In(bucket" in plan or "EqualTo(bucket" in plan
