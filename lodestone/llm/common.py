"""Shared plumbing: distributed prefix sums, and Arrow columns in pieces of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import cut


def written(df: DataFrame, path: str) -> DataFrame:
    """The rows as a new table at a path."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def partitions_for(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def scan(
    df: DataFrame, step: Callable[[pa.Table, dict], pa.RecordBatch | None], order: list[str], value: str | None, schema: str, state: dict | None = None
) -> DataFrame:
    """Rows in global order, with the exclusive prefix sum of ``value`` known to each of them.

    Rows are range-partitioned and sorted by ``order`` and cut there; one number for each
    partition goes to the driver and returns as offsets, so memory is bounded by the
    partition count. ``step(batch, state)`` sees each sorted batch with
    ``state["base"]`` = sum (or count, if ``value`` is None) over all earlier rows, and
    ``state["row"]`` = their count.
    """
    n = partitions_for(df)
    flat = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__pid", F.spark_partition_id()))
    total = F.count(F.lit(1)) if value is None else F.coalesce(F.sum(value), F.lit(0))
    sums = {r["__pid"]: (int(r["t"]), r["n"]) for r in flat.groupBy("__pid").agg(total.cast("long").alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    base, at, row = {}, 0, 0
    for pid in sorted(sums):
        base[pid] = at, row
        at, row = at + sums[pid][0], row + sums[pid][1]
    fixed = state or {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = dict(fixed)
        for b in batches:
            if not b.num_rows:
                continue
            if "base" not in own:
                own["base"], own["row"] = base[b.column("__pid")[0].as_py()]
            out = step(b, own)
            own["base"] += b.num_rows if value is None else int(np.sum(b.column(value).to_numpy(zero_copy_only=False)))
            own["row"] += b.num_rows
            yield out

    return flat.mapInArrow(run, schema)


def with_column(b: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The batch without helper columns, with more columns."""
    names = [n for n in b.schema.names if not n.startswith("__")]
    return pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(v) for v in columns.values()], names=names + list(columns))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if buffers[1] else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that an operator takes out of Arrow at once.
SLICE = 1 << 20
_TRIM: list = []


def give_back() -> None:
    """Return freed memory to the system: Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if not _TRIM:
        try:
            _TRIM.append(ctypes.CDLL("libc.so.6").malloc_trim)
        except (OSError, AttributeError):  # another C library
            _TRIM.append(lambda _: 0)
    _TRIM[0](0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds about ``most`` bytes of text (one row at least).

    Memory that an input batch took goes back to the system once its pieces are done.
    """
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(np.diff(utf8(b.column(text))[1]))
        start = 0
        while start < len(ends):
            base = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(start, stop - start)
            start = stop
        del b, ends
        give_back()


def plain(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns: extra ones, with whatever names, can't clash with helpers."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
