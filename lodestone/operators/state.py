"""Incremental state: pending work, coverage, upserts, checkpoints and what is taken out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.assets import ANALYSIS_VERSION


def valid(features: DataFrame) -> DataFrame:
    """Rows of the current analysis version."""
    return features.where(F.col("analysis_version") >= ANALYSIS_VERSION)


def pending(targets: DataFrame, features: DataFrame) -> DataFrame:
    """Targets (ord, asset_id) without a valid row, in their order."""
    return targets.join(valid(features), "asset_id", "left_anti").orderBy("ord")


def is_complete(targets: DataFrame, features: DataFrame) -> bool:
    return not targets.join(valid(features), "asset_id", "left_anti").head(1)


def coverage(targets: DataFrame, features: DataFrame) -> DataFrame:
    """One row: n_targets, n_covered, n_skipped."""
    have = valid(features).select("asset_id", F.lit(1).alias("have")).distinct()
    out = targets.select("asset_id").distinct().join(have, "asset_id", "left").agg(F.count(F.lit(1)).alias("n_targets"), F.count("have").alias("n_covered"))
    return out.withColumn("n_skipped", F.col("n_targets") - F.col("n_covered"))


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Whole rows by key: the latest by ``order`` wins, a change before a current row of equal order.

    Of changes of equal order the one with the greatest hash of its whole row wins, so the result
    doesn't depend on how rows are divided.
    """
    return latest(current.withColumn("__batch", F.lit(0)).unionByName(changes.withColumn("__batch", F.lit(1)), allowMissingColumns=True), key, order).drop("__batch")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key of rows with ``__batch``: the latest by ``order``, then by batch, then by a hash of the row."""
    by = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__batch"), F.desc(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns if c != "__batch"])))
    return rows.withColumn("__k", F.row_number().over(by)).where("__k = 1").drop("__k")


def latest_checkpoint(checkpoints: DataFrame) -> DataFrame:
    """The incomplete checkpoint that was last updated, if any."""
    return checkpoints.where("not is_complete").orderBy(F.desc("updated_at"), "signature").limit(1)


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Columns that older rows or files lack get their defaults."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def append_album(keepers: DataFrame, title: str, path: str) -> int:
    """Add keepers to an album's rows; the number added (nothing is written for none)."""
    rows = keepers.where("keeper_id is not null").select(F.lit(title).alias("title"), F.col("keeper_id").alias("asset_id"))
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    return n


def deletable(assets: DataFrame, ids: DataFrame) -> DataFrame:
    """Those of the ids that the source lets go; nothing is ever deleted here."""
    return assets.where("can_delete").join(ids.select("asset_id"), "asset_id", "left_semi").select("asset_id")


def without_reviewed(table: DataFrame, reviewed: DataFrame, key: str) -> DataFrame:
    return table.join(reviewed.select(key), key, "left_anti")


def by_ids(rows: DataFrame, ids: DataFrame | list[int], key: str = "asset_id") -> DataFrame:
    """The rows of a set of ids, each row once however often its id is asked for; unknown ids bring nothing.

    A list is small by nature and becomes a filter that reaches the scan; a table becomes a semi join.
    """
    if isinstance(ids, list):
        return rows.where(F.col(key).isin(ids))
    return rows.join(ids.select(key), key, "left_semi")
