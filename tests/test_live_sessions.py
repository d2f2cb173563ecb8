"""Sessions of a stream against sessions of a table."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import sessions as N
from lodestone.sources.tables import shared_path
from lodestone.streaming import live_sessions as L

SCHEMA = "library_id long, asset_id long, capture_ts timestamp, lat double, lon double"


def frame(spark, rows):
    df = spark.createDataFrame(rows, "library_id long, asset_id long, s double, lat double, lon double")
    return df.select("library_id", "asset_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")).alias("capture_ts"), "lat", "lon")


def data(seed, n=300):
    rng, t, out = random.Random(seed), 1_700_000_000.0, []
    for i in range(n):
        t += rng.choice([1, 5, 60, 1799, 1800, 1800.001, 1801, 4000]) if i else 0
        lat = None if rng.random() < 0.3 else 37.0 + rng.choice([0.0, 0.0005, 0.002, 0.01])
        out.append((rng.choice([1, 2, None]), i, t, lat, lat and -122.0))
    return out + [(1, 9_000, None, 1.0, 1.0)]


def sizes(df):
    """The sessions as sets of assets, whatever their numbers."""
    return sorted(tuple(sorted(r.ids)) for r in df.groupBy("library_id", "session").agg(F.collect_list("asset_id").alias("ids")).collect())


def run(spark, parts, delay, close=True):
    source, table, state = (shared_path(spark, x) for x in ("in", "out", "state"))
    schema = frame(spark, [(1, 1, 1.0, 1.0, 1.0)]).schema
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(source)
        query = L.start(spark, source, schema, table, state, delay)
        query.awaitTermination(300)
    if close:
        L.close(spark, source, schema, spark.sql("select timestamp'2030-01-01' capture_ts"))
        query = L.start(spark, source, schema, table, state, delay)
        query.awaitTermination(300)
    return L.read(spark, table), query


@pytest.mark.parametrize(("split", "delay"), [("order", "1 hour"), ("any", "30 days")])
def test_equals_batch_for_any_split(spark, split, delay):
    rows = data(3)
    key = (lambda i: i // 80) if split == "order" else (lambda i: (i * 7919) % 4)
    parts = [[r for r in rows if key(r[1] if r[1] < 9_000 else 0) == k] for k in range(4)]
    got, query = run(spark, parts, delay)
    want = N.sessionize(frame(spark, rows))
    assert sizes(got.where("library_id is not null")) == sizes(want)
    assert got.where("library_id is null").count() == sum(r[0] is None for r in rows)  # a stream of its own
    named = lambda df: sorted((str(r.library_id), r.session, r.asset_id) for r in df.collect() if r.library_id is not None)
    assert named(got) == named(want)
    last = [p for p in query.recentProgress if p["stateOperators"]][-1]
    assert last["stateOperators"][0]["numRowsTotal"] == 0  # every state is dropped after the gap


def test_late_rows_are_counted_and_left_out(spark):
    at = 1_700_000_000.0
    parts = [[(1, 1, at, None, None), (1, 2, at + 100_000, None, None)], [(1, 3, at + 100_100, None, None), (1, 4, at + 10, None, None)]]
    got, query = run(spark, parts, "1 hour", close=False)
    assert L.late(query) == 1
    assert {r.asset_id for r in got.collect()} == {1}  # 2 and 3 wait for the watermark


def test_state_is_small(spark):
    """A row that the watermark has passed is placed and no longer held."""
    import numpy as np

    start, first = L.place((0, np.nan, np.nan, -5, 77), np.array([1, 2]), np.array([10, 10 + L.GAP_US + 1]), np.array([np.nan] * 2), np.array([np.nan] * 2))
    assert start.tolist() == [-5, 11 + L.GAP_US] and first.tolist() == [77, 2]
