"""Nearest places against brute force, and the seams for other distances and altitudes."""

import math
import random

from pyspark.sql import functions as F

from lodestone.operators import groups as G
from lodestone.operators import sessions as N
from lodestone.operators.nearest import nearest, rounds
from lodestone.sources import assets as A


def meters(a, b):
    y1, x1, y2, x2 = map(math.radians, (*a, *b))
    s = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(s), math.sqrt(1 - s))


def test_equals_brute_force(spark):
    rng = random.Random(2)
    places = [(i, rng.uniform(-90, 90), rng.uniform(-180, 180)) for i in range(60)]
    places += [(100, 90.0, 12.0), (101, -90.0, 0.0), (102, 0.0, 180.0), (103, 10.0, -180.0), (104, 37.0, -122.0), (90, 37.0, -122.0), (105, None, 1.0), (106, float("nan"), 1.0)]
    places += [(200 + i, 48 + rng.gauss(0, 0.01), 11 + rng.gauss(0, 0.01)) for i in range(40)]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(80)]
    points += [(48 + rng.gauss(0, 0.02), 11 + rng.gauss(0, 0.02)) for _ in range(40)]
    points += [(90.0, -50.0), (-89.999, 100.0), (0.001, -179.999), (0.0, 180.0), (10.0, 180.0), (37.0, -122.0), (37.0, -122.0), (None, 1.0), (1.0, None)]
    got = nearest(spark.createDataFrame(points, "lat double, lon double"), spark.createDataFrame(places, "place_id long, lat double, lon double")).collect()
    own = [p for p in places if p[1] is not None and not math.isnan(p[1])]
    want = {p: min((round(meters(p, q[1:]), 6), q[0]) for q in own) for p in set(points) if None not in p}
    assert len(got) == len(want)
    for r in got:
        d, name = want[r.lat, r.lon]
        assert abs(r.meters - d) < 1e-3 and (r.place_id == name or abs(meters((r.lat, r.lon), next(q[1:] for q in own if q[0] == r.place_id)) - d) < 1e-5)
    assert next(r.place_id for r in got if r.lat == 37.0) == 90 and rounds() < 20


def test_empty(spark):
    points, none = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double"), spark.createDataFrame([], "place_id long, lat double, lon double")
    assert nearest(points, none, side=0.5).count() == 0 and nearest(points.limit(0), none).count() == 0


def test_joins_are_by_cube(spark):
    points = spark.createDataFrame([(1.0, 2.0)], "lat double, lon double")
    plan = nearest(points, points.withColumn("place_id", F.lit(1)))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_other_face_prints(spark):
    """One-byte tags as face prints: equal tags are one person."""
    rows = [(i, "b", 0, None, None, None, None, 1, [tag], None) for i, tag in enumerate([b"a", b"a", b"b"])]
    df = spark.createDataFrame(rows, "asset_id long, block string, hash long, feature array<double>, capture_ts timestamp, lat double, lon double, face_count int, faceprints array<binary>, color_signature array<int>")
    tag = lambda x, y: F.when(x == y, 0.0).otherwise(1.0)
    found = G.accepted_pairs(df, "balanced", face_distance=tag)
    assert [(r.src, r.dst) for r in found.collect()] == [(0, 1)]


def test_altitudes_of_drone_sessions_only(spark):
    timed = N.sessionize(A.derive_assets(spark, "/root/testdata/sf0.001").where("asset_id < 300")).cache()
    listed = N.sessions(timed)
    asked = []

    def provider(rows):
        asked.extend(r.asset_id for r in rows.select("asset_id").collect())
        return timed.select("asset_id", "altitude").join(rows.select("asset_id"), "asset_id", "left_semi")

    got = N.analyze(N.drone_altitudes(timed, listed, provider), listed)
    drone = timed.join(listed.where("session_type = 'droneLike'").select("library_id", "session"), ["library_id", "session"], "left_semi")
    assert sorted(asked) == sorted(r.asset_id for r in drone.collect()) and 0 < len(asked) < timed.count()
    rows = lambda df: sorted(map(tuple, df.select("library_id", "session", "asset_id", "role").collect()))
    assert rows(got) == rows(N.analyze(timed, listed))
