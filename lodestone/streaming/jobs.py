"""Scans as jobs: a fixed set of targets, analysis in committed batches, and restarts that repeat none.

A job keeps its targets in batches, newest first. What has no valid analysis yet is pending; a batch of
pending rows is analysed and committed to the feature log in one step, under an id of the job and the
batch. A job that stops at any point goes on with the first batch that isn't committed: at most one
batch is analysed again, and its commit counts once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators import state
from lodestone.operators.ordering import numbered
from lodestone.sources.tables import BatchLog, remove, shared_path
from lodestone.streaming.incremental import COMPACT_AFTER, log_of

#: Targets that are analysed and committed at once, unless a job says otherwise.
BATCH_ROWS = 1_000_000
JOURNAL = "signature string, kind string, sensitivity string, job string, is_complete boolean, updated_at timestamp"


@dataclass(frozen=True)
class Coverage:
    """How many targets a scan had, how many of them have a valid analysis, and how many were skipped."""

    targets: int
    covered: int

    @property
    def skipped(self) -> int:
        return self.targets - self.covered


class Journal:
    """Checkpoints of scans as a log: each change is one row, so scans at the same time keep theirs."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.log = spark, BatchLog(spark, f"{store}/checkpoints", f"{JOURNAL}, __batch long")

    def put(self, signature: str, kind: str, sensitivity: str, job: str, complete: bool) -> None:
        row = self.spark.createDataFrame([(signature, kind, sensitivity, job, complete)], "signature string, kind string, sensitivity string, job string, is_complete boolean")
        self.log.commit(row.withColumn("updated_at", F.current_timestamp()).withColumn("__batch", F.lit(int(complete)).cast("long")), uuid.uuid4().hex)
        if self.log.pending() >= COMPACT_AFTER:
            self.log.compact(lambda rows: state.latest(rows, "signature", "updated_at"))

    def read(self) -> DataFrame:
        """The latest checkpoint of each signature."""
        return state.latest(self.log.read(), "signature", "updated_at").drop("__batch")

    def incomplete(self) -> DataFrame:
        return state.latest_checkpoint(self.read())


class ScanJob:
    """One scan of a set of targets; ``store`` keeps its targets, and the features that all scans share."""

    def __init__(self, spark: SparkSession, store: str, schema: StructType, name: str):
        self.spark, self.name, self.schema = spark, name, schema
        self.path = f"{store}/jobs/{name}"
        self.log = log_of(spark, f"{store}/features", StructType([f for f in schema.fields if f.name != "ord"]).add("computed_at", "timestamp"))

    @classmethod
    def begin(cls, targets: DataFrame, store: str, order: list[Column | str], batch_rows: int = BATCH_ROWS) -> ScanJob:
        """Fix the targets, in batches of their order: a batch is a folder, so reading one doesn't read others."""
        spark, name = targets.sparkSession, uuid.uuid4().hex
        job, work = cls(spark, store, targets.schema, name), shared_path(spark, "targets")
        rows = numbered(targets, order, work).withColumn("batch", F.expr(f"ord div {batch_rows}"))
        rows.write.partitionBy("batch").parquet(f"{job.path}/targets")
        remove(spark, work)
        return job

    def targets(self) -> DataFrame:
        """The rows as they were when the job began, with ``ord`` and ``batch``."""
        schema = StructType(list(self.schema.fields)).add("ord", "long").add("batch", "long")
        return self.spark.read.schema(schema).parquet(f"{self.path}/targets")

    def features(self) -> DataFrame:
        """The latest valid analysis of each asset, of all jobs."""
        return state.latest(state.valid(self.log.read()), "asset_id", "computed_at").drop("__batch", "computed_at")

    def pending(self) -> DataFrame:
        """Targets without a valid analysis."""
        return self.targets().join(self.features().select("asset_id"), "asset_id", "left_anti")

    def analyze(self, analyzer: Callable[[DataFrame], DataFrame], most: int | None = None) -> int:
        """Analyse pending batches in order, ``most`` of them at most; how many were committed.

        ``analyzer`` gives rows of the targets' columns with their analysis; those that it leaves out
        stay without one. Batches that this job committed are not analysed again.
        """
        work, done = f"{self.path}/pending-{uuid.uuid4().hex}", 0
        self.pending().write.partitionBy("batch").parquet(work)  # once: a batch then reads its own folder, not the features
        schema = StructType(list(self.schema.fields)).add("ord", "long").add("batch", "long")
        pending = self.spark.read.schema(schema).parquet(work)
        for batch in sorted(r.batch for r in pending.groupBy("batch").count().collect()):
            name = f"{self.name}-{batch:08d}"
            if done == most:
                break
            if self.log.has(name):
                continue
            found = analyzer(pending.where(F.col("batch") == batch).select(*self.schema.names)).select(*self.schema.names)
            done += self.log.commit(found.withColumn("computed_at", F.current_timestamp()).withColumn("__batch", F.lit(batch).cast("long")), name)
            if self.log.pending() >= COMPACT_AFTER:
                self.log.compact(lambda x: state.latest(x, "asset_id", "computed_at"))
        remove(self.spark, work)
        return done

    def result(self, use: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, Coverage]:
        """(``use`` of the targets' analyses, coverage): both come from one read of them.

        ``use`` materializes its rows; what it reads is counted on the way.
        """
        have = self.features().withColumn("__have", F.lit(1))
        seen = Observation("coverage")
        rows = self.targets().select("asset_id").join(have, "asset_id", "left")
        rows = rows.observe(seen, F.count(F.lit(1)).alias("targets"), F.count("__have").alias("covered"))
        out = use(rows.where("__have = 1").select(*self.schema.names))
        return out, Coverage(seen.get["targets"], seen.get["covered"])
