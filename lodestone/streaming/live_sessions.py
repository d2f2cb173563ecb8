"""Sessions of a stream: rows are placed once no earlier one can come, and state goes when its session has ended.

The state of a library is the last placed row, where its session began, and the rows that the watermark
hasn't passed. When the watermark passes rows, they are placed in order of time (then id): each goes on
with the session before it or begins one, by the same gap and distance as in ``sessions.sessionize``. A
session is named by its first row, so no count has to be kept: once the watermark is further than the
gap behind the last row, nothing can go on with that session, and the state is dropped.

Rows that come after the watermark has passed them are late. They are left out and counted by Spark
(``late``); sessionizing the stored rows again takes them in. Rows without a time belong to no session.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from lodestone.operators.sessions import GAP_M, GAP_S
from lodestone.operators.tiles import meters
from lodestone.sources.tables import BatchLog
from lodestone.streaming.incremental import COMPACT_AFTER

PLACED = "library_id long, asset_id long, capture_us long, start_us long, first_id long"
_STATE = "last_us long, last_lat double, last_lon double, start_us long, first_id long, ids array<long>, us array<long>, lats array<double>, lons array<double>"
GAP_US = int(GAP_S * 1_000_000)


def place(last: tuple | None, ids: np.ndarray, us: np.ndarray, lats: np.ndarray, lons: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start_us, first_id) of the session of each row; rows are in order, ``last`` is the row before with its session."""
    before = last if last is not None else (-(1 << 62), math.nan, math.nan, 0, 0)
    shifted = lambda x, first: np.concatenate([[first], x[:-1]]).astype(x.dtype)
    far = meters(shifted(lats, before[1]), shifted(lons, before[2]), lats, lons) > GAP_M
    new = (us - shifted(us, before[0]) > GAP_US) | far
    at = np.maximum.accumulate(np.where(new, np.arange(len(us)), -1))
    return np.where(at < 0, before[3], us[at]), np.where(at < 0, before[4], ids[at])


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, held = None, [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
    if state.exists:
        old = state.get
        last = None if old[0] is None else tuple(old[:5])
        held = [np.array(x, t) for x, t in zip(old[5:], (np.int64, np.int64, float, float), strict=True)]
    new = [f[f["asset_id"].notna()] for f in frames]
    rows = [np.concatenate([h, *[f[c].to_numpy(h.dtype) for f in new]]) for h, c in zip(held, ("asset_id", "us", "lat", "lon"), strict=True)]
    order = np.lexsort((rows[0], rows[1]))
    rows = [x[order] for x in rows]
    watermark = state.getCurrentWatermarkMs()
    n = int(np.searchsorted(rows[1], watermark * 1000, side="right"))
    if n:
        ids, us, lats, lons = (x[:n] for x in rows)
        start, first = place(last, ids, us, lats, lons)
        last = (int(us[-1]), float(lats[-1]), float(lons[-1]), int(start[-1]), int(first[-1]))
        yield pd.DataFrame({"library_id": pd.array([key[0]] * n, "Int64"), "asset_id": ids, "capture_us": us, "start_us": start, "first_id": first})
    left = [x[n:] for x in rows]
    if last is not None and not len(left[0]) and watermark * 1000 > last[0] + GAP_US:
        last = None  # nothing can go on with its session
    if last is None and not len(left[0]):
        if state.exists:
            state.remove()
        return
    state.update((*(last or (None,) * 5), *[x.tolist() for x in left]))
    next_us = int(left[1][0]) if len(left[0]) else last[0] + GAP_US
    state.setTimeoutTimestamp(max(watermark + 1, next_us // 1000 + 1))


def placed(stream: DataFrame, delay: str, library: str = "library_id") -> DataFrame:
    """The stream's rows with their session (``PLACED``), each once the watermark, ``delay`` behind the latest row, has passed it."""
    rows = stream.where("capture_ts is not null").withWatermark("capture_ts", delay)
    # pandas holds no timestamp after 2262, so times go to it as microseconds alone, marked as what the watermark is compared with
    us = F.unix_micros("capture_ts").alias("us", metadata=rows.schema["capture_ts"].metadata)
    rows = rows.select(F.col(library).cast("long").alias("library_id"), "asset_id", us, F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    return rows.groupBy("library_id").applyInPandasWithState(_step, PLACED, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def start(spark: SparkSession, source: str, schema: StructType, table: str, checkpoint: str, delay: str, files_per_batch: int = 100) -> StreamingQuery:
    """Follow Parquet files in ``source`` until all are read; what is placed goes to a log, each batch once."""
    log = BatchLog(spark, table, PLACED)

    def write(batch: DataFrame, number: int) -> None:
        log.commit(batch, f"{number:012d}")
        if log.pending() >= COMPACT_AFTER:
            log.compact(lambda rows: rows)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return placed(stream, delay).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def close(spark: SparkSession, source: str, schema: StructType, at: DataFrame) -> None:
    """End a stream: a row without an id, as late as ``at`` (one row, ``capture_ts``) says, lets the watermark pass all others."""
    others = [F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields if f.name != "capture_ts"]
    at.select("capture_ts", *others).select(schema.names).coalesce(1).write.mode("append").parquet(source)


def read(spark: SparkSession, table: str) -> DataFrame:
    """library_id, session (its number within the library, in order of time), asset_id of what is placed."""
    rows = BatchLog(spark, table, PLACED).read()
    listed = rows.select("library_id", "start_us", "first_id").distinct()  # one row a session
    listed = listed.withColumn("session", F.row_number().over(Window.partitionBy("library_id").orderBy("start_us", "first_id")).cast("long"))
    both = rows.alias("a").join(listed.alias("b"), F.expr("a.library_id <=> b.library_id and a.start_us = b.start_us and a.first_id = b.first_id"))
    return both.select("a.library_id", "b.session", "a.asset_id")


def late(query: StreamingQuery) -> int:
    """How many rows came too late."""
    return sum(int(p["stateOperators"][0]["numRowsDroppedByWatermark"]) for p in query.recentProgress if p["stateOperators"])
