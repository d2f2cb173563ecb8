"""Behaviour of single operators on hand-written rows."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.functions import text as T
from lodestone.operators import groups as G
from lodestone.operators import images, state
from lodestone.operators import sessions as N
from lodestone.sources import assets as A
from lodestone.sources import tables

T0 = datetime(1970, 1, 12, 13, 46, 40)
ASSET = "asset_id long, hash long, pixel_count long, capture_ts timestamp, lat double, lon double, face_count int, faceprints array<array<double>>, color_signature array<int>, feature array<double>, block string"


def asset(i, h=0, px=1000, at=None, lat=None, lon=None, faces=0, prints=None, color=None, feature=None, block="block"):
    return (i, h, px, None if at is None else T0 + timedelta(seconds=at), lat, lon, faces, prints or [], color, feature, block)


def groups(spark, rows, mode="conservative", **k):
    found = {}
    for r in G.group_members(spark.createDataFrame(rows, ASSET), mode, **k).collect():
        found.setdefault(r.group_id, set()).add(r.asset_id)
    return sorted(map(sorted, found.values()))


POSE, FAR = 0x000FFFFF, 0x3FFFFFFF


@pytest.mark.parametrize(
    ("rows", "mode", "want"),
    [
        ([asset(1), asset(2), asset(3, FAR)], "conservative", [[1, 2]]),
        ([asset(1), asset(2, block="other")], "conservative", []),
        ([asset(1), asset(2, (1 << 19) - 1)], "conservative", [[1, 2]]),  # 19 bits
        ([asset(1), asset(2, POSE)], "conservative", []),
        ([asset(1), asset(2, POSE)], "balanced", [[1, 2]]),
        ([asset(1, at=0), asset(2, FAR, at=30)], "balanced", []),
        ([asset(1, at=0), asset(2, FAR, at=30)], "aggressive", [[1, 2]]),
        ([asset(1, at=0), asset(2, FAR, at=700)], "aggressive", []),
        ([asset(1), asset(2, FAR)], "aggressive", []),  # undated: no session
        ([asset(1, at=0, lat=37.0, lon=-122.0), asset(2, FAR, at=1, lat=37.01, lon=-122.0)], "aggressive", []),
        ([asset(1, at=0, color=[255, 0]), asset(2, FAR, at=1, color=[0, 255])], "aggressive", []),
        ([asset(1, faces=1, prints=[[0.0]]), asset(2, faces=1, prints=[[0.5]])], "conservative", [[1, 2]]),
        ([asset(1, faces=1, prints=[[0.0]]), asset(2, faces=1, prints=[[0.6]])], "conservative", []),
        ([asset(1, faces=1), asset(2, faces=1)], "aggressive", []),  # no prints: never together
        ([asset(1, faces=1, prints=[[0.0]]), asset(2)], "aggressive", []),
        ([asset(1, feature=[0.0]), asset(2, feature=[0.9])], "aggressive", []),
        ([asset(1, feature=[0.0]), asset(2, FAR, feature=[0.1])], "balanced", []),  # prefilter
        ([asset(1), asset(2, 0xFF), asset(3, 0xFFFFF)], "conservative", [[1, 2, 3]]),  # transitive
        ([], "balanced", []),
    ],
)
def test_grouping(spark, rows, mode, want):
    assert groups(spark, rows, mode) == want


def test_tiled_blocks_give_all_pairs_once(spark):
    rows = spark.createDataFrame([asset(i, block="b" if i < 60 else "c") for i in range(70)], ASSET)
    pairs = [(r.a_asset_id, r.b_asset_id) for r in G.block_pairs(rows, [], tile=7).collect()]
    assert len(pairs) == len(set(pairs)) == 60 * 59 // 2 + 10 * 9 // 2
    assert all(a < b and (a < 60) == (b < 60) for a, b in pairs)


def test_clashing_columns_change_nothing(spark):
    extra = ["n", "most", "score", "rank", "m0", "reasons", "confidence", "group_id", "tile", "tiles", "p", "q", "cell", "day", "prev", "before", "new", "start", "session"]
    rows = spark.createDataFrame([shot(1, 0.9), shot(2), shot(3, fav=True)], ROW).withColumns({"hash": F.lit(0).cast("long"), "feature": F.lit(None).cast("array<double>"), "block": F.lit("b"), "library_id": F.lit(1).cast("long"), "capture_ts": F.timestamp_seconds(F.col("asset_id") * 1000), "lat": F.lit(None).cast("double"), "lon": F.lit(None).cast("double")})
    odd = rows.withColumns({c: F.lit("x") for c in extra})
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "group_id long, asset_id long")
    for f in (lambda r: G.rank_groups(members, r), lambda r: G.group_confidence(members, r.drop("group_id")), lambda r: G.block_pairs(r, ["hash"], tile=2), lambda r: N.sessionize(r).select("asset_id", "session")):
        assert sorted(map(str, f(odd).collect())) == sorted(map(str, f(rows).collect()))


def test_confidence(spark):
    rows = spark.createDataFrame([asset(1), asset(2), asset(3, 0xFFFF), asset(4, FAR), asset(5, -1)], ASSET)
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)], "group_id long, asset_id long")
    got = {r.group_id: r.confidence for r in G.group_confidence(members, rows).collect()}
    assert got[1] == pytest.approx(1 - (0 + 0.25 + 0.25) / 3) and got[4] == 0.5


ROW = "asset_id long, sharpness double, exposure double, contrast double, motion_blur double, pixel_count long, is_favorite boolean, is_edited boolean, is_live boolean, is_hidden boolean, is_shared boolean, face_count int"


def shot(i, sharp=0.5, px=1000, fav=False, edited=False, live=False, hidden=False, shared=False, faces=0, exposure=0.5, blur=0.0):
    return (i, sharp, exposure, 0.5, blur, px, fav, edited, live, hidden, shared, faces)


def ranking(spark, rows, confidence=None, off=()):
    members = spark.createDataFrame([(1, r[0]) for r in rows], "group_id long, asset_id long")
    sure = spark.createDataFrame([(1, confidence)], "group_id long, confidence double") if confidence is not None else None
    out = G.rank_groups(members, spark.createDataFrame(rows, ROW), sure, off).orderBy("rank").collect()
    return out, out[0].asset_id, [r.asset_id for r in out if r.is_removal], {r.asset_id for r in out if r.is_protected}


def test_ranking(spark):
    assert ranking(spark, [shot(1, 0.2), shot(2, 0.9), shot(3, 0.4)])[1:3] == (2, [3, 1])
    assert ranking(spark, [shot(2), shot(1)])[1] == 1  # ties: the smaller id
    assert ranking(spark, [shot(1), shot(2, px=500, sharp=0.75), shot(3, sharp=0.1)])[1] == 1  # equal scores: more pixels
    _, keeper, gone, kept = ranking(spark, [shot(1, 0.9), shot(2, fav=True), shot(3, edited=True), shot(4, live=True), shot(5, hidden=True), shot(6, shared=True), shot(7, faces=1), shot(8)])
    assert kept == {2, 3, 4, 5, 6, 7} and set(gone) == {8, 1} - {keeper}
    people = [shot(1, 0.9), shot(2, faces=1, sharp=0.1), shot(3, faces=1, fav=True, sharp=0.1)]
    assert ranking(spark, people)[2] == [] and ranking(spark, people, 0.96)[2] == [2] and ranking(spark, people, 0.94)[2] == []
    assert ranking(spark, people[:2])[2] == [2]  # groups of two
    assert ranking(spark, [shot(1, 0.9), shot(2, live=True), shot(3)], off=("livePhoto",))[2] == [2, 3]


def test_badges(spark):
    rows = {r.asset_id: list(r.badges) for r in ranking(spark, [shot(1, 0.9, exposure=0.9), shot(2, 0.2, px=900, fav=True), shot(3, 0.9, blur=0.7, px=900)])[0]}
    assert rows[1] == ["Sharpest", "Best exposure", "Highest resolution"]
    assert rows[2] == ["Lower resolution", "Favorite", "Blurry", "Protected"] and rows[3] == ["Lower resolution", "Blurry"]


def test_plan_and_stats(spark):
    rows = [shot(1, 0.9), shot(2), shot(3, fav=True), shot(4, 0.9), shot(5, live=True, fav=True)]
    members = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (4, 4), (4, 5)], "group_id long, asset_id long")
    data = spark.createDataFrame(rows, ROW)
    ranked = G.rank_groups(members, data)
    plan = G.cleanup_plan(ranked).first()
    assert (plan.n_groups, plan.n_protected, plan.savings) == (2, 2, None)
    sizes = data.select("asset_id", F.lit(7).alias("bytes"))
    assert G.cleanup_plan(ranked, sizes).first().savings == 7 * plan.n_removals
    assert {r.group_id: r.warning for r in G.decisions(ranked).collect()}[4] in ("allProtected", None)
    stats = G.cleanup_stats(ranked, data).first()
    assert (stats.group_count, stats.protected_favorites, stats.protected_live) == (2, 2, 1)
    assert tuple(G.snapshot(members).first()) == (2, 3)
    toggled = spark.createDataFrame([(1, 2), (1, 3)], "group_id long, asset_id long")
    before = {r.asset_id for r in ranked.where("is_removal").collect()}
    assert {r.asset_id for r in G.override_removals(ranked, toggled).collect()} == before ^ {2, 3}


SESSION = "asset_id long, capture_ts timestamp, lat double, lon double, burst_id string, library_id int"


def sessions(spark, rows):
    data = spark.createDataFrame([(i, None if at is None else T0 + timedelta(seconds=at), lat, lon, burst, 0) for i, (at, lat, lon, burst) in enumerate(rows)], SESSION)
    out = N.sessionize(data)
    kinds = {r.session: r.session_type for r in N.sessions(out).collect()}
    found = {}
    for r in out.orderBy("asset_id").collect():
        found.setdefault(r.session, []).append(r.asset_id)
    return [(found[k], kinds[k]) for k in sorted(found)]


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([(0, None, None, None), (10, None, None, None)], [([0, 1], "burst")]),
        ([(0, None, None, "x"), (900, None, None, "x")], [([0, 1], "burst")]),
        ([(0, 37.0, -122.0, None), (600, 37.0005, -122.0, None)], [([0, 1], "droneLike")]),
        ([(0, None, None, None), (600, None, None, None)], [([0, 1], "photoSession")]),
        ([(0, None, None, None), (1500, None, None, None), (3000, None, None, None)], [([0, 1, 2], "event")]),
        ([(0, None, None, None), (1801, None, None, None)], [([0], "photoSession"), ([1], "photoSession")]),
        ([(0, None, None, None), (1800, None, None, None)], [([0, 1], "photoSession")]),
        ([(0, 37.0, -122.0, None), (60, 37.01, -122.0, None)], [([0], "photoSession"), ([1], "photoSession")]),
        ([(0, 37.0, -122.0, None), (40, None, None, None), (80, 37.01, -122.0, None)], [([0, 1, 2], "droneLike")]),
        ([(None, None, None, None), (5, None, None, None)], [([1], "photoSession")]),
        ([(36000, None, None, None), (37000, None, None, None), (200000, None, None, None)], [([0, 1], "photoSession"), ([2], "photoSession")]),  # over midnight
        ([], []),
    ],
)
def test_sessions(spark, rows, want):
    assert sessions(spark, rows) == want


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_scalars(spark):
    key = lambda ts, w, h, s: S.blocking_key(F.lit(ts).cast("timestamp"), F.lit(w), F.lit(h), F.lit(s))
    r = one(spark, a=key("2026-06-17 23:59:00", 4000, 3000, False), b=key(None, 16, 9, True), c=key(None, 5, 0, False), d=key("2026-01-01 00:00:00", 1780, 1000, False))
    assert tuple(r) == ("2026-168|13|p", "nodate|17|s", "nodate|0|p", "2026-001|17|p")
    r = one(spark, a=S.hamming(F.lit(0), F.lit(-1).cast("long")), b=S.location_bucket(F.lit(1.00005), F.lit(-2.0)), c=S.location_bucket(F.lit(None).cast("double"), F.lit(1.0)), d=S.altitude(F.lit(5.0), F.lit(1)))
    assert r.b == "1.0001,-2.0000" and r.c is None and r.d == -5.0
    unique = lambda *v: S.unique_angle(*[F.lit(x).cast("double") for x in v])
    r = one(spark, a=unique(0, 8, *[None] * 6), b=unique(0, 7.9, *[None] * 6), c=unique(None, 8, 37, -122, 37.0003, -122, None, None), d=unique(*[None] * 6, 1.0, 1.3), e=unique(*[None] * 6, 0, 1.3))
    assert tuple(r) == (True, False, True, True, False)
    color = lambda a, b: S.color_similarity(F.lit(a).cast("array<int>"), F.lit(b).cast("array<int>"))
    r = one(spark, a=color([255, 0], [0, 255]), b=color([10, 10], [5, 20]), c=color([0], [0]), d=color([1], [1, 2]))
    assert tuple(r) == (0.0, 0.75, None, None)
    assert tuple(one(spark, a=S.percent(F.lit(0.996)), b=S.percent(F.lit(0.996), False), c=S.clamp(F.lit(3.0)))) == (100, 99, 1.0)


NOW = datetime(2026, 6, 17, 15, 30)


def parsed(spark, *texts):
    return T.parse_requests(spark.createDataFrame([(t,) for t in texts], "text string"), NOW).collect()


def test_parser(spark):
    a, b, c, d, e, f, g = parsed(spark, "Find duplicates from last weekend", "hello there", "scan my dog photos carefully", "show pictures at Mall of America without screenshots", "  ", None, "clean drone shots past weekend")
    assert (a.phrase, str(a.start_ts), str(a.end_ts), a.recent_limit) == ("lastWeekend", "2026-06-13 00:00:00", "2026-06-15 00:00:00", None)
    assert a.summary == "Balanced scan of photos from last weekend, including screenshots."
    assert not b.understood and b.mode == "balanced" and b.recent_limit == 300 and b.location_query is None
    assert (c.content_query, c.location_query, c.mode, c.understood) == ("dog", None, "conservative", True)
    assert (d.location_query, d.recent_limit, d.include_screenshots) == ("mall america", 1000, False)
    assert d.summary == "Balanced scan of your 1000 most recent photos at mall america, excluding screenshots."
    assert not e.understood and not f.understood and e.mode is None and g.phrase == "lastWeek" and g.sensitivity == "aggressive"
    assert all(r.require_review for r in (a, b, c, d, g))


def test_sentences(spark):
    badges = lambda *b: T.keeper_summary(F.lit(list(b)).cast("array<string>"))
    r = one(spark, a=badges("Sharpest", "Highest resolution"), b=badges(), c=badges("Sharpest", "Best exposure", "Favorite"), d=T.removal_summary(F.array(F.lit("Lower resolution"), F.lit("Blurry"))), e=T.protection_summary(F.array(F.lit("favorite"), F.lit("edited"))))
    assert r.a == "Recommended because it is the sharpest image and has the highest resolution."
    assert r.b == "Recommended as the best of this group."
    assert r.c == "Recommended because it is the sharpest image, has the best exposure, and is a favorite."
    assert r.d == "Suggested removal because it is visually similar and has more motion blur."
    assert r.e == "Protected because it is a favorite and it has edits."
    n = lambda *v: [F.lit(x) for x in v]
    r = one(spark, a=T.cleanup_summary(*n(2, 1, 1, 0, 3)), b=T.cleanup_summary(*n(0, 0, 0, 0, 0)), c=T.session_summary(*n(1, 2, 1, 0)), d=T.last_scan_summary(*n(1, 4)))
    assert r.a == "I found 2 similar-photo groups. I recommend reviewing 1 photo for cleanup. I protected 1 favorite and 3 photos with people."
    assert r.b.startswith("No duplicate groups yet.")
    assert r.c == "Found 1 sequence group. Recommended 2 best shots. Protected 1 unique angle. Suggested removing 0 redundant photos."
    assert r.d == "Your last scan found 1 group with about 4 photos you can review."


def test_state(spark, tmp_path, monkeypatch):
    features = spark.createDataFrame([(1, 3), (2, 2), (3, 4)], "asset_id long, analysis_version int")
    targets = spark.createDataFrame([(5, 0), (2, 1), (1, 2)], "asset_id long, ord int")
    assert [r.asset_id for r in state.pending(targets, features).collect()] == [5, 2]
    assert tuple(state.coverage(targets, features).first()) == (3, 1, 2)
    assert not state.is_complete(targets, features) and state.is_complete(targets.where("asset_id = 1"), features)
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "asset_id long, meta string, computed_at int")
    new = spark.createDataFrame([(1, "c", 1), (2, "d", 4), (3, "e", 0)], "asset_id long, meta string, computed_at int")
    path = str(tmp_path / "features")
    kind = "asset_id long, meta string, computed_at int"
    read = lambda: {(r.asset_id, r.meta) for r in tables.read_table(spark, path, kind).collect()}
    assert read() == set()
    tables.replace_table(old, path)
    tables.replace_table(state.upsert(tables.read_table(spark, path, kind), new, "asset_id", "computed_at"), path)
    assert read() == {(1, "c"), (2, "b"), (3, "e")}
    # a crash before the pointer moves leaves the table as it was, and the next replacement clears up
    with monkeypatch.context() as m:
        m.setattr(tables, "write_json", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            tables.replace_table(old.limit(0), path)
    assert read() == {(1, "c"), (2, "b"), (3, "e")}
    tables.replace_table(tables.read_table(spark, path, kind).where("asset_id = 3"), path)
    assert read() == {(3, "e")} and len([x for x in os.listdir(path) if x.startswith("v-")]) == 2
    # changes of equal order: the result doesn't depend on how rows are divided
    ties = spark.createDataFrame([(1, x, 9) for x in "pqrst"], kind)
    assert len({state.upsert(old, ties.repartition(n), "asset_id", "computed_at").where("asset_id = 1").first().meta for n in (1, 3, 5)}) == 1
    assert {r.asset_id for r in state.by_ids(old, [2, 2, 7]).collect()} == {2} and state.by_ids(old, new.union(new)).count() == 2
    keepers = spark.createDataFrame([(1,), (None,)], "keeper_id long")
    assert state.append_album(keepers, "Best", str(tmp_path / "albums")) == 1
    assert state.append_album(keepers.limit(0), "Best", str(tmp_path / "albums")) == 0
    assert state.with_defaults(new, {"meta": "?", "flag": False}).first().flag is False


def test_scan_requests():
    a = A.Request(A.Recent(300))
    assert a.signature != A.Request(A.Recent(300), sensitivity="aggressive").signature != A.Request(A.Recent(300), kind="sessions").signature
    assert A.tokens("Mall of America 24!") == ["mall", "america"] and A.tokens("Route 66 and 101", digits=True) == ["route", "and", "101"]


def test_images(spark):
    flat, split = [128] * 4096, [0] * 2048 + [255] * 2048
    rows = spark.createDataFrame([(1, flat), (2, split), (3, [1])], "i int, p array<int>").select("i", images.quality_metrics("p").alias("q")).orderBy("i").collect()
    assert rows[0].q.sharpness == 0 and rows[0].q.exposure > 0.99 and rows[1].q.sharpness > 0.2 and rows[1].q.contrast == 1 and rows[2].q.sharpness == 0.5
    down = list(range(72, 0, -1))
    r = one(spark, a=images.dhash(F.lit(down).cast("array<int>")), b=images.dhash(F.lit(down[::-1]).cast("array<int>")), c=images.dhash(F.lit([1]).cast("array<int>")))
    assert tuple(r) == (-1, 0, None)


def test_streaming(spark, tmp_path, monkeypatch):
    from lodestone.streaming import incremental

    data = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "asset_id long, meta string, computed_at int")
    source, table, at = (str(tmp_path / x) for x in ("in", "table", "checkpoint"))
    monkeypatch.setattr(incremental, "COMPACT_AFTER", 2)
    run = lambda: incremental.start(spark, source, data.schema, table, at).awaitTermination(120)
    read = lambda: {(r.asset_id, r.meta) for r in incremental.read_features(spark, table, data.schema).collect()}
    data.write.parquet(source)
    run()
    assert read() == {(1, "a"), (2, "b")}
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], data.schema).write.mode("append").parquet(source)
    run()  # the second batch: a base takes both in
    log = incremental.log_of(spark, table, data.schema)
    assert read() == {(1, "a"), (2, "c"), (3, "d")} and log.pending() == 0
    assert not log.commit(data.selectExpr("*", "0L __batch"), "000000000001")  # a batch that comes again changes nothing
    spark.createDataFrame([(1, "late", 0), (3, "e", 1)], data.schema).write.mode("append").parquet(source)
    run()
    assert read() == {(1, "a"), (2, "c"), (3, "e")} and log.pending() == 1  # older rows lose, and so do earlier batches at equal order
