"""Counts of pairs by tiles against the predicates of single pairs."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.operators import groups as G

SCHEMA = "asset_id long, block string, hash long, feature array<double>, capture_ts timestamp, lat double, lon double, face_count int, faceprints array<array<double>>, color_signature array<int>"


def odd_rows(spark, n, seed):
    """Rows with nulls in all places, equal ids, prints and signatures of several sizes, times at the limit."""
    rng = random.Random(seed)
    maybe = lambda x: None if rng.random() < 0.15 else x
    number = lambda: rng.choice([0.0, 0.1, 0.55, 0.6, None])
    out = []
    for i in range(n):
        near = rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)
        prints = [maybe([number() for _ in range(rng.choice([1, 1, 2]))]) for _ in range(rng.choice([0, 1, 1, 2, 3]))]
        colors = [rng.choice([0, 1, 5, 9, None]) for _ in range(rng.choice([0, 2, 2, 3]))]
        out.append((rng.choice([i, i - 1 if i else 0]), rng.choice(["a", "a", "b"]), maybe(near - (1 << 63) if rng.random() < 0.5 else near >> 1), None, maybe(rng.choice([0.0, 600.0, 600.000001, 1200.0])), maybe(rng.choice([37.0, 37.0003, 37.002])), maybe(-122.0), maybe(rng.choice([0, 0, 1, 1, 2])), maybe(prints), maybe(colors)))
    df = spark.createDataFrame([(9_999, "alone", 1, None, None, None, None, 0, [], None), *out], SCHEMA.replace("capture_ts timestamp", "s double"))
    return df.select(*[F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + F.lit(17_000_000_000_000_000)).alias("capture_ts") if c == "s" else c for c in df.columns])


@pytest.mark.parametrize("tile", [7, 1000])
def test_counts_equal_predicates(spark, monkeypatch, tile):
    rows = odd_rows(spark, 120, 4).cache()
    tests = [G.near_bits(), G.in_session(), G.of_pair(S.same_people, "face_count", "faceprints"), G.of_pair(S.similar_color, "color_signature")]
    want = G.block_pairs(rows, G.PAIR).groupBy("block").agg(F.count(F.lit(1)), *[F.count_if(c) for c in tests]).collect()
    assert min(min(r[1:]) for r in want) > 10
    assert sorted(map(tuple, G.pair_counts(rows, tile).collect())) == sorted(map(tuple, want))


def test_pairs_never_become_rows(spark):
    from lodestone.plans.catalog import QUERIES

    plan = QUERIES["pair_predicates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "a_asset_id" not in plan
