"""A dense block stores the stars of its links, not all of its pairs."""

from lodestone.operators import groups as G
from lodestone.sources.tables import shared_path
from lodestone.streaming import growing
from tests.test_growing import chain, stored


def test_dense_block_stores_stars(spark, monkeypatch):
    sizes, settle = [], growing.components_within
    monkeypatch.setattr(growing, "components_within", lambda edges, block: sizes.append(edges.count()) or settle(edges, block))
    rows = chain(spark, [0] * 1).drop("asset_id").crossJoin(spark.range(40).withColumnRenamed("id", "asset_id")).select("asset_id", *[c for c in G.PAIR if c != "asset_id"], "block")
    g = growing.GrowingGroups(spark, shared_path(spark, "growing"), rows.schema)
    g.add(rows, 0)
    assert sizes[0] <= 39 * 8  # 780 pairs; each task keeps one star
    assert stored(g) == [(0, i) for i in range(40)]
