"""Groups that grow: each batch of assets meets only the blocks it touches, and stored groups are merged.

The stored table has a row an asset: what pairs are judged by, its block and its group. A batch reads the rows
of its blocks, makes pairs of which one side at least is new, and replaces both sides by the groups
they stand for. Components of these few edges say which groups merge; their members are renamed. Since
a group is named by its smallest member, the groups after each batch are those of a computation anew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import groups as G
from lodestone.operators import state
from lodestone.operators.graph import components_within, thinned
from lodestone.sources.tables import BatchLog, cut
from lodestone.streaming.incremental import COMPACT_AFTER

#: Buckets of blocks: rows are sorted by them, so a reader that asks for some skips row groups of others.
BUCKETS = 1024


class GrowingGroups:
    """Groups at one sensitivity, kept in a log below ``store``; ``schema`` is that of the assets with ``block``."""

    def __init__(self, spark: SparkSession, store: str, schema: StructType, sensitivity: str = "balanced"):
        self.spark, self.sensitivity = spark, sensitivity
        columns = ["asset_id", "block", *[c for c in G.PAIR if c != "asset_id"]]
        own = StructType([schema[c] for c in columns]).add("bucket", "integer").add("group_id", "long").add("__batch", "long")
        self.columns, self.log = columns, BatchLog(spark, store, own)

    @staticmethod
    def _bucket():
        return F.pmod(F.xxhash64("block"), F.lit(BUCKETS)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        return state.latest(rows, "asset_id", "__batch").drop("__batch")

    def touched(self, blocks: DataFrame) -> DataFrame:
        """Stored rows of these blocks; the scan is told their buckets."""
        buckets = [r.bucket for r in blocks.select(self._bucket().alias("bucket")).distinct().collect()]  # at most BUCKETS
        return self._latest(self.log.read().where(F.col("bucket").isin(buckets)).join(blocks, "block", "left_semi"))

    def add(self, assets: DataFrame, batch: int) -> bool:
        """Take in new assets with their block; False if this batch was taken in before.

        An asset that is stored already stays as it is. Batches come in the order of their numbers, one at a time.
        """
        if self.log.has(f"{batch:012d}"):
            return False
        new = assets.select(*self.columns).dropDuplicates(["asset_id"])
        blocks = cut(new.select("block").distinct())
        old = cut(self.touched(blocks))
        new = cut(new.join(old.select("asset_id"), "asset_id", "left_anti"))
        # where most pairs are linked, only the stars of their components are stored and meet groups
        edges = cut(thinned(self._linked(new, old), "block"))
        # an old row stands for its group, so an edge joins groups and rows without one
        stands = old.where("group_id is not null").select("asset_id", "group_id")
        for end in ("src", "dst"):
            edges = edges.join(stands.select(F.col("asset_id").alias(end), F.col("group_id").alias("__g")), end, "left").withColumn(end, F.coalesce("__g", end)).drop("__g")
        found = cut(components_within(cut(edges.distinct()), "block"))
        named = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
        stored = old.withColumn("__now", F.coalesce("group_id", "asset_id")).join(named, F.col("__now") == F.col("__node"), "left")
        changed = stored.where("__component is not null and __component is distinct from group_id").withColumn("group_id", F.col("__component"))
        fresh = new.withColumn("bucket", self._bucket()).join(named, F.col("asset_id") == F.col("__node"), "left").withColumn("group_id", F.col("__component"))
        names = [*self.columns, "bucket", "group_id"]
        rows = fresh.select(*names).unionByName(changed.select(*names)).withColumn("__batch", F.lit(batch).cast("long"))
        done = self.log.commit(self._placed(rows), f"{batch:012d}")
        if self.log.pending() >= COMPACT_AFTER:
            self.log.compact(lambda x: self._placed(state.latest(x, "asset_id", "__batch")))
        return done

    def _linked(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """Accepted pairs of which one side at least is new; large blocks are tested in arrays, tile by tile."""
        both = new.select(*self.columns, F.lit(True).alias("new")).unionByName(old.select(*self.columns, F.lit(False).alias("new")))
        large = G.large_blocks(both.select(F.col("block").alias("__block")), G.TILE)
        found = []
        if large.head(1):
            found = [G.tiled_pairs(both.join(*G.of_large(large, "block", "left_semi")), large, self.sensitivity)]
            new, old = (x.join(*G.of_large(large, "block", "left_anti")) for x in (new, old))
        found += [G.block_pairs(new, G.PAIR, G.cheap_test(self.sensitivity), tile=None), G.cross_pairs(new, old, G.PAIR, G.cheap_test(self.sensitivity))]
        return reduce(DataFrame.unionByName, [G.judged(x, self.sensitivity) for x in found])

    @staticmethod
    def _placed(rows: DataFrame) -> DataFrame:
        return rows.repartitionByRange("bucket").sortWithinPartitions("bucket", "block")

    def members(self) -> DataFrame:
        """group_id, asset_id of groups of two or more."""
        return self._latest(self.log.read()).where("group_id is not null").select("group_id", "asset_id")
