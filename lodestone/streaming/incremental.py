"""Incremental analysis: new asset files become batches of a feature table, each committed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lodestone.operators.state import latest
from lodestone.sources.tables import BatchLog

#: Batches after which the base takes them in: a reader merges no more than these and the base.
COMPACT_AFTER = 20


def log_of(spark: SparkSession, table: str, schema: StructType) -> BatchLog:
    return BatchLog(spark, table, StructType([*schema.fields, *StructType().add("__batch", "long").fields]))


def read_features(spark: SparkSession, table: str, schema: StructType, key: str = "asset_id", order: str = "computed_at") -> DataFrame:
    """The feature table: of each key's rows in the base and the batches since, the latest."""
    return latest(log_of(spark, table, schema).read(), key, order).drop("__batch")


def start(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, analyze: Callable[[DataFrame], DataFrame] = lambda df: df, result: StructType | None = None, key: str = "asset_id", order: str = "computed_at", files_per_batch: int = 100) -> StreamingQuery:
    """Follow Parquet files in ``source`` until all are read; each batch is one whole-row upsert.

    A batch writes its own rows and commits by its id, so one that is repeated after a failure changes
    nothing and the rest of the table isn't rewritten. Every ``COMPACT_AFTER`` batches the base takes
    them in. ``analyze`` makes rows of the schema ``result`` (``schema`` if it isn't given).
    """
    log = log_of(spark, table, result or schema)

    def write(batch: DataFrame, number: int) -> None:
        log.commit(lambda: analyze(batch).withColumn("__batch", F.lit(number).cast("long")), f"{number:012d}")
        if log.pending() >= COMPACT_AFTER:
            log.compact(lambda rows: latest(rows, key, order))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
