"""Gap-and-distance sessions, their types, and what to keep of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.operators import groups as G
from lodestone.sources.tables import cut

GAP_S, GAP_M = 1800.0, 150.0
BURST_S, PASS_S = 30.0, 1200.0


def sessionize(assets: DataFrame, library: str = "library_id") -> DataFrame:
    """Dated rows with ``session``: a number within the library, in time order (then id).

    A session ends after more than 30 minutes, or more than 150 m if both neighbours have
    coordinates. Windows run within (library, day), so a library's whole history never meets in
    one task; one row a day carries the last capture and the count of sessions to later days.
    """
    rows = assets.drop("session").where("capture_ts is not null").withColumn("__day", F.to_date("capture_ts"))
    key = ["capture_ts", "lat", "lon"]
    last = F.struct(*key)
    days = rows.groupBy(library, "__day").agg(F.max_by(last, F.struct("capture_ts", "asset_id")).alias("__last"))
    days = days.withColumn("__prev", F.lag("__last").over(Window.partitionBy(library).orderBy("__day"))).select(library, "__day", "__prev")
    own = Window.partitionBy(library, "__day").orderBy("capture_ts", "asset_id")
    rows = rows.join(days, [library, "__day"]).withColumn("__before", F.coalesce(F.lag(last).over(own), F.col("__prev")))
    b = F.col("__before")
    far = F.coalesce(S.meters(b["lat"], b["lon"], F.col("lat"), F.col("lon")) > GAP_M, F.lit(False))
    new = b.isNull() | (S.seconds(F.col("capture_ts"), b["capture_ts"]) > GAP_S) | far
    rows = cut(rows.withColumn("__new", new.cast("int")).drop("__before", "__prev"))
    per_day = rows.groupBy(library, "__day").agg(F.sum("__new").alias("__n"))
    before = Window.partitionBy(library).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_day.select(library, "__day", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = own.rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, [library, "__day"]).withColumn("session", F.col("__start") + F.sum("__new").over(within)).drop("__new", "__start", "__day")


def sessions(rows: DataFrame, library: str = "library_id") -> DataFrame:
    """One row a session: n, start_ts, end_ts, span, bucket of its first located row, session_type."""
    agg = rows.groupBy(library, "session").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("capture_ts").alias("start_ts"),
        F.max("capture_ts").alias("end_ts"),
        F.min_by(S.location_bucket(F.col("lat"), F.col("lon")), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct("capture_ts", "asset_id"))).alias("bucket"),
        F.countDistinct("burst_id").alias("bursts"),
        F.count("burst_id").alias("in_burst"),
        F.bool_or(F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("located"),
    )
    span = S.seconds(F.col("end_ts"), F.col("start_ts"))
    shared = (F.col("bursts") == 1) & (F.col("in_burst") == F.col("n"))
    kind = (
        F.when((F.col("n") >= 2) & (shared | (span <= BURST_S)), "burst")
        .when((F.col("n") >= 2) & F.col("located") & (span <= PASS_S), "droneLike")
        .when(span <= GAP_S, "photoSession")
        .otherwise("event")
    )
    return agg.select(library, "session", "n", "start_ts", "end_ts", span.alias("span"), "bucket", kind.alias("session_type"))


def drone_altitudes(rows: DataFrame, listed: DataFrame, provider: Callable[[DataFrame], DataFrame], library: str = "library_id") -> DataFrame:
    """Rows with the altitudes (asset_id, altitude) that ``provider`` gives for members of droneLike sessions, which alone it is asked for.

    Sessions are typed before, so a provider that opens files opens no others.
    """
    asked = rows.drop("altitude").join(listed.where("session_type = 'droneLike'").select(library, "session"), [library, "session"], "left_semi")
    return rows.drop("altitude").join(provider(asked).select("asset_id", "altitude"), "asset_id", "left")


def analyze(rows: DataFrame, listed: DataFrame, off: tuple[str, ...] = (), library: str = "library_id") -> DataFrame:
    """Members with a role: best, protected or redundant.

    Within each session rows group at balanced sensitivity. A group's best is kept; what is in no
    group is protected, and so are members that the policy protects (people included, however sure
    the group) or that show a unique angle. Altitudes count in droneLike sessions only.
    """
    rows = G.with_block(rows).withColumn("block", F.concat_ws("|", library, "session", "block"))
    members = cut(G.group_members(rows, "balanced"))
    ranked = G.rank_groups(members, rows, off=off).select("group_id", "asset_id", "is_keeper", "reasons")
    data = rows.join(listed.select(library, "session", "session_type"), [library, "session"])
    data = data.select("asset_id", library, "session", "session_type", "lat", "lon", (F.col("width") / F.nullif(F.col("height"), F.lit(0))).alias("aspect"), F.when(F.col("session_type") == "droneLike", F.col("altitude")).alias("altitude"))
    known = data.join(ranked, "asset_id", "left")
    keeper = known.where("is_keeper").select("group_id", *[F.col(c).alias(f"k_{c}") for c in ("lat", "lon", "aspect", "altitude")])
    # what is in no group has no keeper to meet: as a null key it would all go to one task
    both = known.where("group_id is not null").join(keeper, "group_id", "left").unionByName(known.where("group_id is null"), allowMissingColumns=True)
    unique = S.unique_angle(F.col("altitude"), F.col("k_altitude"), F.col("lat"), F.col("lon"), F.col("k_lat"), F.col("k_lon"), F.coalesce("aspect", F.lit(0.0)), F.coalesce("k_aspect", F.lit(0.0)))
    role = F.when(F.col("group_id").isNull(), "protected").when(F.col("is_keeper"), "best").when((F.size("reasons") > 0) | unique, "protected").otherwise("redundant")
    return both.select(library, "session", "session_type", "asset_id", role.alias("role"))


def session_stats(roles: DataFrame, library: str = "library_id") -> DataFrame:
    """One row: sessions, best shots, protected, redundant."""
    n = roles.agg(F.countDistinct(library, "session").alias("clusters"), *[F.count_if(F.col("role") == r).alias(r) for r in ("best", "protected", "redundant")])
    return n


#: A stored session.
RECORD = "library_id long, session long, session_type string, start_ts timestamp, end_ts timestamp, n_best long, n_protected long, n_redundant long"


def records(roles: DataFrame, listed: DataFrame, library: str = "library_id") -> DataFrame:
    """One row a session for the store: its type, times and how many members have each role (none where it has no roles)."""
    counts = roles.groupBy(library, "session").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("best", "protected", "redundant")])
    out = listed.join(counts, [library, "session"], "left").fillna(0, ["n_best", "n_protected", "n_redundant"])
    return out.select(F.col(library).cast("long").alias("library_id"), F.col("session").cast("long").alias("session"), "session_type", "start_ts", "end_ts", "n_best", "n_protected", "n_redundant")
