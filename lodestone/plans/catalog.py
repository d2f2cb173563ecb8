"""Named queries over the tables of a data folder, and SQL with the same results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, ShortType, StructField, StructType

from lodestone.functions import similarity as S
from lodestone.functions import text as T
from lodestone.operators import groups as G
from lodestone.operators import images, state
from lodestone.operators import sessions as N
from lodestone.plans.oracles import ORACLES
from lodestone.sources import assets as A
from lodestone.sources import files
from lodestone.sources.tables import BatchLog, Deletions, cut, read_table, replace_table, shared_path

__all__ = ["ORACLES", "QUERIES"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
NOW = datetime(2026, 6, 17, 15, 30)
TS = "date_format({0}, 'yyyy-MM-dd HH:mm:ss')"


def query(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Register a query over the derived assets under its function's name."""
    QUERIES[f.__name__] = lambda spark, sf_dir: f(A.derive_assets(spark, sf_dir))
    return f


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


# scans


@query
def scan_recent(assets):
    return A.scan(assets, A.Request(A.Recent(300)), in_order=True).select("asset_id", stamp("capture_ts"))


@query
def scan_date_range(assets):
    bounds = assets.agg(F.min("capture_ts").alias("low")).first()["low"]
    end = bounds.replace(microsecond=0)
    from datetime import timedelta

    request = A.Request(A.DateRange(bounds, end + timedelta(days=40)), A.Options(include_screenshots=False, exclude_favorites=False))
    return A.scan(assets, request, in_order=True).select("asset_id", stamp("capture_ts"))


@query
def scan_album(assets):
    return A.scan(assets, A.Request(A.Album(3)), A.album_members(assets), in_order=True).select("asset_id")


@query
def album_listing(assets):
    return A.albums(A.album_members(assets)).select("album_id", "title", "n_images")


@query
def album_search(assets):
    listed = A.albums(A.album_members(assets))
    return A.find_albums(listed, text="TRIP 1").union(A.find_albums(listed, ids=[2, 99])).select("album_id", "title")


@query
def content_filter(assets):
    return A.scan(assets, A.Request(A.Everything(), A.Options(exclude_favorites=False, content_query="Dogs & puppies, gold!"))).select("asset_id")


@query
def location_filter(assets):
    request = A.Request(A.Everything(), A.Options(exclude_favorites=False, location_query="bay north", location_lookup=True))
    return A.scan(assets, request, place_table=A.places(assets)).select("asset_id")


# scalars


@query
def blocking_key(assets):
    return G.with_block(assets).select("asset_id", "block")


@query
def location_bucket(assets):
    return assets.select("asset_id", S.location_bucket(F.col("lat"), F.col("lon")).alias("bucket"), S.location_bucket(F.col("lat"), F.col("lon"), 2).alias("coarse"), S.altitude(F.col("altitude"), F.col("asset_id") % 2).alias("meters_above"))


@query
def protection_reasons(assets):
    rows = assets.withColumn("has_people", F.col("face_count") > 0)
    return rows.select("asset_id", F.array_join(S.protection_reasons(), ",").alias("reasons"), F.array_join(S.protection_reasons(("livePhoto",)), ",").alias("without_live"))


@query
def quality_score(assets):
    rows = assets.withColumn("has_people", F.col("face_count") > 0)
    return rows.select("asset_id", F.round(S.quality_score(F.lit(12_000_000).cast("long")), 9).alias("score"))


# pairs


@query
def hamming_pairs(assets):
    pairs = G.block_pairs(G.with_block(assets), ["hash"], G.near_bits())
    return pairs.groupBy("block").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(G.of_pair(S.hamming, "hash")).cast("long").alias("bits"))


@query
def pair_predicates(assets):
    """How many pairs of each block pass each predicate."""
    return G.pair_counts(G.with_block(assets))


def scene_pairs(assets: DataFrame) -> DataFrame:
    return G.block_pairs(assets.withColumn("scene_key", F.col("scene")), G.PAIR, block="scene_key")


@query
def pair_distance(assets):
    return scene_pairs(assets).select("a_asset_id", "b_asset_id", F.round(G.of_pair(S.pair_distance, "feature", "hash"), 9).alias("distance"))


@query
def color_similarity(assets):
    return scene_pairs(assets).select("a_asset_id", "b_asset_id", F.round(G.of_pair(S.color_similarity, "color_signature"), 9).alias("similarity"))


@query
def face_set_match(assets):
    return scene_pairs(assets).select("a_asset_id", "b_asset_id", G.of_pair(S.same_people, "face_count", "faceprints").alias("same"), F.round(G.of_pair(S.worst_face_match, "faceprints"), 9).alias("worst"))


@query
def great_circle(assets):
    return scene_pairs(assets).select("a_asset_id", "b_asset_id", F.round(S.meters(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 4).alias("meters"))


def _by_sensitivity(name: str, f: Callable[[DataFrame, str], DataFrame]) -> None:
    for s in S.SENSITIVITIES:
        QUERIES[f"{name}_{s}"] = lambda spark, sf_dir, s=s: f(G.with_block(A.derive_assets(spark, sf_dir)), s)


_by_sensitivity("accepted_pairs", lambda rows, s: G.accepted_pairs(rows, s).select("src", "dst", F.round("distance", 9).alias("distance")))
_by_sensitivity("connected_components", G.group_members)


# groups


def grouped(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, members) at balanced sensitivity."""
    rows = G.with_block(assets)
    return rows, cut(G.group_members(rows, "balanced"))


def sure_groups(assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, members, confidence): for queries that read the confidence, which costs a join of all members with their rows."""
    rows, members = grouped(assets)
    return rows, members, cut(G.group_confidence(members, rows))


def ranked_groups(assets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    rows, members, confidence = sure_groups(assets)
    return rows, members, confidence, cut(G.rank_groups(members, rows, confidence))


@query
def group_confidence(assets):
    return sure_groups(assets)[2].select("group_id", "n", F.round("confidence", 6).alias("confidence"))


@query
def groups_by_confidence(assets):
    c = sure_groups(assets)[2]
    return c.orderBy(F.desc("confidence"), "group_id").select("group_id", S.percent(F.col("confidence")).alias("spoken"), S.percent(F.round("confidence", 9), False).alias("shown"))


@query
def placeholder_keeper(assets):
    rows, members = grouped(assets)
    return G.placeholder_keeper(members, rows)


@query
def best_shot_rank(assets):
    r = ranked_groups(assets)[3]
    return r.select("group_id", "asset_id", F.round("score", 9).alias("score"), "rank", "is_keeper", "is_protected", "is_removal")


@query
def badges(assets):
    r = ranked_groups(assets)[3]
    return r.select("asset_id", F.array_join("badges", ",").alias("badges"), T.protection_summary(F.col("reasons")).alias("protection"), T.removal_summary(F.col("badges")).alias("removal"))


@query
def keeper_override(assets):
    rows, members, _, r = ranked_groups(assets)
    some = r.where(F.col("group_id") % 3 != 0)  # groups whose rows are gone keep their placeholder
    return G.keepers(G.placeholder_keeper(members, rows), some)


@query
def best_shots(assets):
    rows, members, _, r = ranked_groups(assets)
    return G.keepers(G.placeholder_keeper(members, rows), r).where("keeper_id is not null").select("keeper_id")


@query
def cleanup_plan(assets):
    rows, _, _, r = ranked_groups(assets)
    return G.cleanup_plan(r, rows.select("asset_id", F.col("pixel_count").alias("bytes")))


@query
def cleanup_warnings(assets):
    return G.decisions(ranked_groups(assets)[3])


@query
def cleanup_stats(assets):
    rows, _, _, r = ranked_groups(assets)
    s = G.cleanup_stats(r, rows)
    return s.withColumn("summary", T.cleanup_summary(*[F.col(c) for c in ("group_count", "reviewable", "protected_favorites", "protected_live", "protected_people")]))


@query
def duplicate_snapshot(assets):
    s = G.snapshot(grouped(assets)[1])
    return s.withColumn("summary", T.last_scan_summary(F.col("group_count"), F.col("reviewable")))


@query
def keeper_summary(assets):
    r = ranked_groups(assets)[3].where("is_keeper")
    return r.select("group_id", T.keeper_summary(F.col("badges")).alias("summary"))


@query
def group_details(assets):
    r = ranked_groups(assets)[3]
    d = G.decisions(r).join(r.where("is_keeper").select("group_id", "badges", "confidence", "n"), "group_id")
    return d.select("group_id", T.group_details(F.round("confidence", 9), F.col("n"), F.col("badges"), F.col("n_removals"), F.col("n_protected")).alias("details"))


@query
def top_group(assets):
    """The surest group, explained by its stored keeper ranked without confidence."""
    rows, members, c = sure_groups(assets)
    top = c.orderBy(F.desc(F.round("confidence", 9)), "group_id").limit(1).select("group_id")
    r = G.rank_groups(members.join(top, "group_id", "left_semi"), rows)
    return r.where("is_keeper").select("group_id", F.col("asset_id").alias("keeper_id"), T.keeper_summary(F.col("badges")).alias("summary"))


@query
def keeper_explanations(assets):
    """Keeper's badges and the different negative badges of what would go, by group."""
    return explained(ranked_groups(assets)[3]).select("group_id", "keeper_badges", "removal_badges")


def explained(ranked: DataFrame) -> DataFrame:
    """group_id, keeper_badges, removal_badges and confidence of the keeper: one aggregation of what is ranked."""
    bad = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("is_removal"), F.array_intersect("badges", F.array(*map(F.lit, G.NEGATIVE))))))))
    own = lambda c: F.max(F.when(F.col("is_keeper"), c))
    return ranked.groupBy("group_id").agg(own(F.array_join("badges", ",")).alias("keeper_badges"), F.array_join(bad, ",").alias("removal_badges"), own(F.col("confidence")).alias("confidence"))


@query
def manual_override(assets):
    r = ranked_groups(assets)[3]
    toggled = r.where(F.col("asset_id") % 5 == 0).select("group_id", "asset_id")
    return G.override_removals(r, toggled)


# sessions


def analyzed(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = cut(N.sessionize(assets))
    listed = cut(N.sessions(rows))
    return listed, N.analyze(rows, listed)


@query
def sessionize(assets):
    return N.sessionize(assets).select("library_id", "session", "asset_id")


@query
def session_type(assets):
    s = N.sessions(N.sessionize(assets))
    return s.select("library_id", "session", "n", stamp("start_ts"), stamp("end_ts"), F.round("span", 6).alias("span"), "bucket", "session_type")


@query
def session_best_shots(assets):
    return analyzed(assets)[1].select("library_id", "session", "asset_id", "role")


@query
def suggested_removals(assets):
    roles = analyzed(assets)[1]
    kept = roles.where("role in ('best', 'protected')").select("asset_id")
    return roles.select("asset_id").join(kept, "asset_id", "left_anti")


@query
def session_summary_stats(assets):
    s = N.session_stats(analyzed(assets)[1])
    return s.withColumn("summary", T.session_summary(F.col("clusters"), F.col("best"), F.col("protected"), F.col("redundant")))


@query
def unique_angle(assets):
    rows = assets.withColumn("aspect", F.col("width") / F.col("height"))
    a, b = rows.where("variant = 0"), rows.where("variant > 0")
    a = a.select("scene", *[F.col(c).alias(f"k_{c}") for c in ("altitude", "lat", "lon", "aspect")])
    unique = S.unique_angle(F.col("altitude"), F.col("k_altitude"), F.col("lat"), F.col("lon"), F.col("k_lat"), F.col("k_lon"), F.col("aspect"), F.col("k_aspect"))
    return b.join(a, "scene").select("asset_id", unique.alias("is_unique"))


# state


def features_and_targets(assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    targets = assets.where("asset_id % 3 <> 1").select("asset_id", (-F.col("asset_id")).alias("ord"))
    return assets.where("asset_id % 4 <> 0").select("asset_id", "analysis_version", "sharpness"), targets


@query
def pending_work(assets):
    features, targets = features_and_targets(assets)
    return state.pending(targets, features).select("asset_id", "ord")


@query
def scan_coverage(assets):
    features, targets = features_and_targets(assets)
    return state.coverage(targets, features)


@query
def feature_upsert(assets):
    old = assets.select("asset_id", "sharpness", F.lit(1).alias("computed_at")).where("asset_id % 2 = 0")
    new = assets.select("asset_id", F.col("exposure").alias("sharpness"), F.when(F.col("asset_id") % 5 == 0, 0).otherwise(1).alias("computed_at")).where("asset_id % 3 = 0")
    return state.upsert(old, new, "asset_id", "computed_at")


@query
def checkpoint_latest(assets):
    rows = assets.groupBy("library_id").agg(F.max("asset_id").alias("updated_at"))
    rows = rows.select(F.concat(F.lit("recent:"), F.col("library_id").cast("string")).alias("signature"), "updated_at", (F.col("library_id") % 4 == 3).alias("is_complete"))
    return state.latest_checkpoint(rows)


@query
def batched_commits(assets):
    """Two batches of features and a third that is sent twice, with a base in between: the latest row of each asset."""
    from lodestone.streaming.incremental import latest

    rows = assets.select("asset_id", "sharpness", F.lit(1).cast("long").alias("computed_at"))
    log = BatchLog(assets.sparkSession, shared_path(assets.sparkSession, "features"), "asset_id long, sharpness double, computed_at long, __batch long")
    merge = lambda df: latest(df, "asset_id", "computed_at")
    log.commit(rows.where("asset_id % 2 = 0").withColumn("__batch", F.lit(0).cast("long")), "0")
    log.compact(merge)
    log.commit(rows.where("asset_id % 3 = 0").withColumn("sharpness", F.lit(2.0)).withColumn("__batch", F.lit(1).cast("long")), "1")
    log.compact(merge)
    for value in (3.0, 4.0):  # the second time it is there
        log.commit(rows.where("asset_id % 5 = 0").withColumn("sharpness", F.lit(value)).withColumn("computed_at", F.col("asset_id") % 2).withColumn("__batch", F.lit(2).cast("long")), "2")
    return merge(log.read()).drop("__batch")


@query
def checkpoint_upsert(assets):
    """Each library's scan begins, and those of even libraries are marked complete later."""
    begun = assets.groupBy("library_id").agg(F.min("asset_id").alias("updated_at")).select(F.concat(F.lit("recent:"), F.col("library_id").cast("string")).alias("signature"), "updated_at", F.lit(False).alias("is_complete"), "library_id")
    done = begun.where("library_id % 2 = 0").withColumn("updated_at", F.col("updated_at") + 1).withColumn("is_complete", F.lit(True))
    return state.upsert(begun, done, "signature", "updated_at").drop("library_id")


@query
def assets_by_id(assets):
    """Assets of a table of ids, some of them twice, some unknown."""
    ids = assets.where("asset_id % 7 = 0").select("asset_id")
    asked = ids.union(ids.where("asset_id % 2 = 0")).union(ids.select(-F.col("asset_id") - 1))
    return state.by_ids(assets, asked).select("asset_id", "width", "height", A.aspect(F.col("width"), F.col("height")).alias("aspect"))


@query
def cache_scan(assets):
    """Valid stored analyses of the targets."""
    features, targets = features_and_targets(assets)
    return state.by_ids(state.valid(features), targets).select("asset_id", "sharpness")


@query
def browse(assets):
    """The 300 newest, favorites included."""
    return A.scan(assets, A.Request(A.Recent(300), A.Options(exclude_favorites=False)), in_order=True).select("asset_id", stamp("capture_ts"))


@query
def deletable(assets):
    """What the source lets go of the ids that a person confirmed, some of them unknown."""
    ids = assets.where("asset_id % 3 = 0").select("asset_id")
    return state.deletable(assets.withColumn("can_delete", ~F.col("is_shared")), ids.union(ids.select(-F.col("asset_id"))))


@query
def stored_groups(assets):
    """Groups that replace older ones in the store, read back."""
    spark, at = assets.sparkSession, shared_path(assets.sparkSession, "groups")
    members = grouped(assets)[1]
    replace_table(members.where("group_id % 2 = 0"), at)
    replace_table(members, at)
    return read_table(spark, at, "group_id long, asset_id long")


@query
def reviewed_groups(assets):
    """Stored groups without those that were reviewed: in two batches, one of them sent twice, with a compaction between."""
    spark, members = assets.sparkSession, grouped(assets)[1]
    at = shared_path(spark, "groups")
    replace_table(members, at)
    stored = Deletions(spark, at, "group_id long, asset_id long", ["group_id"])
    stored.delete(members.where("group_id % 6 = 0"), "a")
    stored.compact()
    for _ in range(2):
        stored.delete(members.where("group_id % 6 = 3"), "b")
    return stored.read()


@query
def group_by_id(assets):
    """The members of one group, looked up by its id."""
    members = grouped(assets)[1]
    return members.where(F.col("group_id") == members.agg(F.max("group_id").alias("id")).first()["id"])


@query
def album_append(assets):
    """Keepers that are appended to an album, and no rows from an empty list."""
    spark, at = assets.sparkSession, shared_path(assets.sparkSession, "albums")
    best = G.placeholder_keeper(*grouped(assets)[::-1])
    state.append_album(best, "Best", at)
    state.append_album(best.limit(0), "None", at)
    return spark.read.schema("title string, asset_id long").parquet(at)


@query
def stored_sessions(assets):
    """Sessions with their roles, written, replaced and read back: the newest first, as records for the sink."""
    spark, at = assets.sparkSession, shared_path(assets.sparkSession, "sessions")
    listed, roles = analyzed(assets)
    roles = cut(roles)
    for rows in (roles.where("role = 'best'"), roles):
        replace_table(N.records(rows, listed), at)
    return read_table(spark, at, N.RECORD).orderBy(F.desc("start_ts"), "library_id", "session").select("library_id", "session", "session_type", stamp("start_ts"), "n_best", "n_protected", "n_redundant")


@query
def request_signatures(assets):
    """Names of resumable jobs: an album scan and a scan of its dates, for the albums as they are."""
    rows = A.album_members(assets).join(assets.select("asset_id", "capture_ts"), "asset_id").groupBy("album_id").agg(F.min(F.unix_timestamp("capture_ts")).alias("low"), F.max(F.unix_timestamp("capture_ts")).alias("high"))
    found, at = [], lambda s: datetime.fromtimestamp(s, UTC)
    for r in rows.orderBy("album_id").collect():  # albums as a person lists them
        for kind, scope in (("duplicates", A.Album(r.album_id)), ("sessions", A.DateRange(at(r.low), at(r.high)))):
            found.append((r.album_id, kind, A.Request(scope, A.Options(r.album_id % 2 == 0, content_query="dogs"), kind=kind).signature))
    return assets.sparkSession.createDataFrame(found, "album_id long, kind string, signature string")


def interrupted(assets: DataFrame, kind: str = "duplicates"):
    """An engine whose scan of everything was stopped after two of about five batches, and again after two more."""
    from lodestone.plans.tools import Engine

    store, size = shared_path(assets.sparkSession, "scan"), assets.count() // 5 + 1
    engine = lambda: Engine(assets.sparkSession, assets, store, batch_rows=size)
    first = engine()
    first.begin(first.request(A.Everything(), kind=kind), 2)
    second = engine()
    second.job(second.incomplete().first()).analyze(second.analyzer, 2)
    return engine()


@query
def resumed_scan(assets):
    """Groups of a scan that was stopped twice and then continued."""
    engine = interrupted(assets)
    engine.continue_last_scan()
    return engine.groups().select("group_id", "asset_id", "keeper_id")


def exif_headers(assets: DataFrame) -> DataFrame:
    """asset_id, content: the head of a JPEG file with a GPS block, made from the asset; some big-endian, little-endian, below sea level, cut off, or without it."""
    number = lambda value, size: F.lpad(F.hex(value), 2 * size, "0")
    swapped = lambda text, size: F.concat(*[F.substring(text, 2 * i + 1, 2) for i in reversed(range(size))])

    def block(order, below: int):
        n = lambda value, size: (lambda text: text if order == "4D4D" else swapped(text, size))(number(F.lit(value) if isinstance(value, int) else value, size))
        entry = lambda tag, kind, value: F.concat(n(tag, 2), n(kind, 2), n(1, 4), value)
        gps = [n(2, 2), entry(5, 1, F.lit(f"0{below}000000")), entry(6, 5, n(56, 4)), n(0, 4)]
        return F.concat(F.lit("FFD8" + b"Exif\0\0".hex() + order), n(42, 2), n(8, 4), n(1, 2), entry(0x8825, 4, n(26, 4)), n(0, 4), *gps, n(F.col("asset_id") % 9000, 4), n(F.col("asset_id") % 7 + 1, 4))

    kind = F.col("asset_id") % 5
    whole = F.when(kind.isin(0, 3), block("4D4D", 0)).when(kind == 1, block("4949", 0)).when(kind == 2, block("4949", 1)).otherwise(F.lit("FFD8FFE0"))
    return assets.select("asset_id", F.unhex(F.when(kind == 3, F.substring(whole, 1, 120)).otherwise(whole)).alias("content"))


@query
def exif_altitudes(assets):
    """Altitudes read from the heads of files."""
    return exif_headers(assets).select("asset_id", F.round(files.altitude_of("content"), 9).alias("altitude"))


def nearest_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest supplier to each customer's coordinates, which are spread over the globe, poles and date line included."""
    from lodestone.operators.nearest import nearest

    spot = lambda key, a, b: [(F.col(key) * a % 181 - 90).cast("double").alias("lat"), (F.col(key) * b % 361 - 180).cast("double").alias("lon")]
    customers, suppliers = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "supplier"))
    places = suppliers.select(F.col("s_suppkey").alias("place_id"), *spot("s_suppkey", 53, 97))
    points = customers.select("c_custkey", *spot("c_custkey", 37, 73))
    found = nearest(points, places)
    return points.join(found, ["lat", "lon"]).select("c_custkey", "place_id", F.round("meters", 3).alias("meters"))


QUERIES["nearest_place"] = nearest_place


@query
def streamed_sessions(assets):
    """Sessions of a stream of five arrivals, in which rows come up to two days out of order."""
    from lodestone.streaming import live_sessions

    spark = assets.sparkSession
    source, stored, checkpoint = (shared_path(spark, f"sessions-{x}") for x in ("in", "out", "state"))
    rows = assets.select("library_id", "asset_id", "capture_ts", "lat", "lon").withColumn("arrival", F.unix_timestamp("capture_ts") + F.pmod("asset_id", F.lit(3)) * 86_400)
    bounds = rows.approxQuantile("arrival", [0.2, 0.4, 0.6, 0.8], 0.01)
    split = sum(((F.col("arrival") > b).cast("int") for b in bounds), F.lit(0))
    for i in range(5):
        rows.where(split == i).drop("arrival").repartition(4).write.mode("append").parquet(source)
    schema = rows.drop("arrival").schema
    live_sessions.close(spark, source, schema, assets.agg((F.max("capture_ts") + F.expr("interval 10 days")).alias("capture_ts")))
    live_sessions.start(spark, source, schema, stored, checkpoint, "3 days", files_per_batch=4).awaitTermination()
    return live_sessions.read(spark, stored)


@query
def growing_groups(assets):
    """Groups that grew over five batches of assets in no order of time, one batch sent twice."""
    from lodestone.streaming.growing import GrowingGroups

    rows = G.with_block(assets)
    grown = GrowingGroups(assets.sparkSession, shared_path(assets.sparkSession, "growing"), rows.schema)
    for i in (0, 1, 2, 2, 3, 4):
        grown.add(rows.where(F.pmod(F.xxhash64("asset_id"), F.lit(5)) == i), i)
    return grown.members()


@query
def resumed_coverage(assets):
    """How many targets a continued scan had, covered and skipped, as its own read of them counted."""
    engine = interrupted(assets, "sessions")
    engine.continue_last_scan()
    c = engine.coverage
    return assets.sparkSession.createDataFrame([(c.targets, c.covered, c.skipped, engine.incomplete().count())], "n_targets long, n_covered long, n_skipped long, n_incomplete long")


@query
def prompts(assets):
    """Texts for a language model that explains each keeper, with facts only."""
    facts = explained(ranked_groups(assets)[3])
    return facts.select("group_id", T.keeper_prompt(F.round("confidence", 9), F.col("keeper_badges"), F.col("removal_badges")).alias("prompt"))


# requests


def requests_table(assets: DataFrame) -> DataFrame:
    """A request for each asset, put together from words."""
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(F.col("asset_id") / by) % len(words) + 1).cast("int"))
    text = F.concat_ws(
        " ",
        pick(["Find", "hello", "please clean", "Scan my", "show"], 1),
        pick(["photos", "dogs", "photos of beach sunset", "duplicates at Mall of America", ""], 5),
        pick(["", "last weekend", "from past month", "yesterday", "past weekend", "TODAY", "last year", "this week"], 25),
        pick(["", "carefully", "thorough", "balanced", "drone"], 200),
        pick(["", "no screenshots"], 2),
    )
    return assets.select("asset_id", F.when(F.col("asset_id") % 61 == 0, "  ").otherwise(text).alias("text"))


@query
def nl_parse(assets):
    out = T.parse_requests(requests_table(assets), NOW)
    return out.select("asset_id", "mode", "phrase", stamp("start_ts"), stamp("end_ts"), "recent_limit", "include_screenshots", "content_query", "location_query", "sensitivity", "understood", "summary")


@query
def date_phrases(assets):
    out = assets
    for name in T.DATE_PHRASES:
        start, end = T.date_range(F.lit(name), F.col("capture_ts"))
        out = out.withColumn(f"{name}_start", F.date_format(start, "yyyy-MM-dd HH:mm:ss")).withColumn(f"{name}_end", F.date_format(end, "yyyy-MM-dd HH:mm:ss"))
    return out.select("asset_id", *[f"{n}_{x}" for n in T.DATE_PHRASES for x in ("start", "end")])


@query
def draft_resolve(assets):
    drafts = requests_table(assets).select(
        "asset_id", "text", F.when(F.col("asset_id") % 3 == 0, "aggressive").when(F.col("asset_id") % 3 == 1, "Safe mode").otherwise("?").alias("draft_mode"),
        F.element_at(F.array(*map(F.lit, T.PHRASE_WORD)), (F.col("asset_id") % 6 + 1).cast("int")).alias("draft_phrase"),
        F.when(F.col("asset_id") % 2 == 0, " Dogs ").otherwise("none").alias("draft_content"), F.when(F.col("asset_id") % 5 == 0, "Paris").otherwise(" ").alias("draft_location"), (F.col("asset_id") % 7 != 0).alias("draft_screenshots"),
    )
    return T.resolve_drafts(drafts, NOW).select("asset_id", "mode", "phrase", "content_query", "location_query", "recent_limit", "summary")


# images


def gray(assets: DataFrame, n: int) -> DataFrame:
    value = lambda i: ((F.col("scene") * 31 + i * i * (F.col("variant") + 3) + i * 17) % 256).cast("int")
    n_tasks = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes before, many after
    return assets.repartition(n_tasks, "asset_id").select("asset_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), value).alias("pixels"))


@query
def dhash(assets):
    return gray(assets, 72).select("asset_id", images.dhash(F.col("pixels")).alias("hash"))


@F.arrow_udf(ArrayType(ShortType()))
def drawn(scene: pa.Array, variant: pa.Array, n: pa.Array) -> pa.Array:
    """The gray levels that ``gray`` has, made where a kernel reads them: of chained Arrow UDFs no pixel passes between Spark and Python."""
    size = n[0].as_py() if len(n) else 0
    scene, variant, i = np.asarray(scene), np.asarray(variant), np.arange(size)
    byte = lambda x: (x & 255).astype(np.uint8)
    squares, line, at, by = byte(i * i), byte(i * 17), byte(scene * 31), byte(variant + 3)
    out = np.empty((len(scene), size), np.int16)
    for k in range(0, len(scene), images.AT_ONCE):
        some = slice(k, k + images.AT_ONCE)
        out[some] = squares * by[some, None] + line + at[some, None]  # bytes wrap around at 256
    for k in np.flatnonzero((scene < 0) | (variant < -3)):  # a remainder has the sign of its dividend, as in SQL
        out[k] = np.fmod(scene[k] * 31 + i * i * (variant[k] + 3) + i * 17, 256)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(scene) + 1, dtype=np.int32) * size), pa.array(out.ravel()))


@F.arrow_udf(ArrayType(StructType([StructField(c, IntegerType()) for c in "rgba"])))
def colored(gray_levels: pa.Array) -> pa.Array:
    """Pixels of gray levels: multiples of them, clear where nine divides them."""
    p = np.asarray(gray_levels.flatten()).astype(np.int32)
    parts = [p, p * 3 % 256, p * 7 % 256, np.where(p % 9 == 0, 0, 255).astype(np.int32)]
    return pa.ListArray.from_arrays(gray_levels.offsets, pa.StructArray.from_arrays([pa.array(x) for x in parts], names=list("rgba")))


def pictures(assets: DataFrame, n: int) -> DataFrame:
    """asset_id and what ``gray`` draws, as one Arrow UDF."""
    n_tasks = int(assets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes before, many after
    return assets.select("asset_id", F.col("scene").cast("long"), F.col("variant").cast("long")).repartition(n_tasks, "asset_id").select("asset_id", drawn("scene", "variant", F.lit(n)).alias("pixels"))


@query
def quality_metrics(assets):
    small = pictures(assets, 4096).withColumn("q", images.quality_metrics("pixels"))
    return small.select("asset_id", *[F.round(f"q.{c}", 9).alias(c) for c in ("sharpness", "exposure", "contrast", "motion_blur")])


@query
def color_histogram(assets):
    rows = pictures(assets, 256).select("asset_id", images.color_signature(colored("pixels")).alias("signature"))
    return rows.select("asset_id", F.array_join(F.col("signature").cast("array<string>"), ",").alias("signature"))


@query
def largest_faces(assets):
    boxes = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.struct((i / 20.0).alias("x"), (i / 10.0).alias("y"), ((F.col("asset_id") * i % 7 + 1) / 40.0).alias("w"), (i / 50.0).alias("h")))
    faces = images.largest_faces(boxes)
    crop = images.face_crop(F.element_at(faces, 1), F.col("width").cast("double"), F.col("height").cast("double"))
    return assets.select("asset_id", faces.alias("faces"), crop.alias("crop")).select("asset_id", F.array_join(F.transform("faces", lambda f: F.round(f["x"] * 20, 0).cast("int").cast("string")), ",").alias("order"), F.round("crop.w", 6).alias("crop_w"), F.round("crop.y", 6).alias("crop_y"))
