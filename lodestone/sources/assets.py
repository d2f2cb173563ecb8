"""The assets table: derivation from event rows, scopes, options and albums."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows analysed by an older version of the extractors count as not analysed.
ANALYSIS_VERSION = 3

ASSETS = """
select asset_id, scene, variant, library_id, capture_ts, lat, lon, width, height,
 width*height - variant*1000 pixel_count, is_screenshot, hash, 'image' media_type,
 ((asset_id*37)%101)/100.0D sharpness, ((asset_id*53)%101)/100.0D exposure, ((asset_id*71)%101)/100.0D contrast,
 1.0D - ((asset_id*37)%101)/100.0D motion_blur,
 asset_id%17=0 is_favorite, asset_id%23=0 is_edited, asset_id%13=0 is_live, asset_id%97=0 is_hidden, asset_id%89=0 is_shared,
 face_count, case when scene%9=0 then concat('B',cast(scene as string)) end burst_id,
 case when scene%10<3 then array(cast(scene%97 as double), cast(scene%89 as double), variant*0.3D) end feature,
 case when face_count=0 or scene%7=0 then cast(array() as array<array<double>>) else transform(sequence(1,face_count), f -> array(cast(scene*10+f as double), case when variant=3 then 0.9D else variant*0.1D end)) end faceprints,
 case when scene%11<>0 then array(cast(200-variant*40 as int), cast(variant*40 as int), cast(scene%50 as int), 10) end color_signature,
 case when scene%5<>0 then 100.0D + variant*3 end altitude,
 filter(array(named_struct('label',case when scene%3=0 then 'golden dog' else 'mountain lake' end,'confidence',0.2D+(asset_id%50)/100.0D), named_struct('label','party','confidence',(asset_id%20)/100.0D)), x -> x.label is not null) labels,
 cast(case when asset_id%41=0 then 2 else 3 end as int) analysis_version
from (select *, cast(case when scene%6=0 then 1+scene%3 else 0 end as int) face_count from (select event_id asset_id, scene, variant, scene%16 library_id,
  case when scene%50=49 then null else cast(scene_ts + make_dt_interval(cast((scene div 250)*30 as int),0,0,cast(variant*20 as int)) as timestamp) end capture_ts,
  case when scene%5=0 then null else 37.0D + (scene%7)*0.01D + variant*0.0002D end lat,
  case when scene%5=0 then null else -122.0D end lon,
  case scene%4 when 0 then 4000 when 1 then 3000 when 2 then 1920 else 1170 end width,
  case scene%4 when 0 then 3000 when 1 then 4000 when 2 then 1080 else 2532 end height,
  scene%4=3 is_screenshot,
  (((scene*48271+11)*69621)%2147483647*4294967296 + ((scene*16807+7)*39373)%2147483647*2)
    ^ (case variant when 0 then 0L when 1 then 7L when 2 then 1048575L else 1073741823L end) hash
 from (select event_id, event_id div 4 scene, event_id%4 variant, min(ts) over (partition by event_id div 4) scene_ts from {events})))
"""


def derive_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four variants of each scene, as deterministic functions of the events table.

    Day keys are those of the session's time zone, which a driver sets: nothing is set here.
    """
    return spark.sql(ASSETS, events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def aspect(width: Column, height: Column) -> Column:
    """Width by height, 0 where there is no height."""
    return F.when(height > 0, width / height).otherwise(F.lit(0.0))


def album_members(assets: DataFrame) -> DataFrame:
    """album_id, title, is_shared, asset_id: an asset is in the album of its scene's last digit."""
    return assets.select(
        (F.col("scene") % 10).alias("album_id"),
        F.concat(F.when(F.col("scene") % 20 < 10, "Trip ").otherwise("trip "), (F.col("scene") % 10).cast("string")).alias("title"),
        (F.col("scene") % 10 == 9).alias("is_shared_album"),
        "asset_id",
    )


def albums(members: DataFrame) -> DataFrame:
    """Albums with images, without shared ones, by title regardless of case."""
    counted = members.where("not is_shared_album").groupBy("album_id").agg(F.min("title").alias("title"), F.count(F.lit(1)).alias("n_images"))
    return counted.where("n_images > 0").orderBy(F.lower("title"), "album_id")


def find_albums(listed: DataFrame, text: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Albums by id or by a part of their title, else all."""
    if ids is not None:
        return listed.where(F.col("album_id").isin(ids))
    return listed.where(F.lower("title").contains(text.lower())) if text else listed


@dataclass(frozen=True)
class Recent:
    limit: int

    @property
    def signature(self) -> str:
        return f"recent:{self.limit}"


@dataclass(frozen=True)
class Everything:
    @property
    def signature(self) -> str:
        return "all"


@dataclass(frozen=True)
class DateRange:
    start: datetime
    end: datetime
    end_exclusive: bool = False

    @property
    def signature(self) -> str:
        return f"date:{self.start.timestamp():.0f}-{self.end.timestamp():.0f}"


@dataclass(frozen=True)
class Album:
    album_id: int

    @property
    def signature(self) -> str:
        return f"album:{self.album_id}"


Scope = Everything | Recent | DateRange | Album


@dataclass(frozen=True)
class Options:
    include_screenshots: bool = True
    exclude_favorites: bool = True
    content_query: str | None = None
    location_query: str | None = None
    location_lookup: bool = False

    @property
    def signature(self) -> str:
        return "|".join(str(x) for x in (self.include_screenshots, self.exclude_favorites, self.content_query or "", self.location_query or ""))


@dataclass(frozen=True)
class Request:
    scope: Scope
    options: Options = Options()
    sensitivity: str = "balanced"
    kind: str = "duplicates"

    @property
    def signature(self) -> str:
        """Names a resumable job: its kind, scope, options and sensitivity."""
        return "|".join((self.kind, self.scope.signature, self.options.signature, self.sensitivity))


def tokens(text: str, digits: bool = False) -> list[str]:
    """Lower-case runs of letters (and digits) of three or more."""
    word = "".join(c if c.isalpha() or digits and c.isnumeric() else " " for c in text.lower())
    return [w for w in word.split() if len(w) >= 3]


def matches_content(query: str, labels: Column, least: float = 0.1) -> Column:
    """Any word of the query and any confident label contain one another; no words match all."""
    words = tokens(query)
    if not words:
        return F.lit(True)
    sure = F.filter(labels, lambda x: x["confidence"] >= least)
    return F.coalesce(F.exists(sure, lambda x: _any(F.lower(x["label"]).contains(w) | F.contains(F.lit(w), F.lower(x["label"])) for w in words)), F.lit(False))


def _any(parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def matches_place(query: str, fields: Column) -> Column:
    """Every word of the query is in some place field; no words match all."""
    out = F.lit(True)
    for w in tokens(query, digits=True):
        out = out & F.coalesce(_some_field(w, fields), F.lit(False))
    return out


def _some_field(word: str, fields: Column) -> Column:
    return F.exists(fields, lambda f: F.lower(f).contains(word))


def place_key(lat: Column, lon: Column) -> Column:
    """One cell of about 100 m, null without coordinates."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string("%.3f,%.3f", F.round(lat, 3), F.round(lon, 3)))


def places(assets: DataFrame) -> DataFrame:
    """Lookup from cell to place names (stands for a geocoder's table; one row a cell)."""
    cells = assets.where("lat is not null and lon is not null").select(place_key(F.col("lat"), F.col("lon")).alias("cell"), F.floor((F.round("lat", 3) - 37) * 100 + 0.05).cast("int").alias("n")).groupBy("cell").agg(F.min("n").alias("n"))
    return cells.select("cell", F.array(F.concat(F.lit("Bay Harbor "), F.col("n").cast("string")), F.when(F.col("n") % 2 == 0, "North Point").otherwise("South Shore")).alias("fields"))


def scan(assets: DataFrame, request: Request, members: DataFrame | None = None, place_table: DataFrame | None = None, in_order: bool = False) -> DataFrame:
    """Assets of a request; newest first (undated last, then by id) if ``in_order``.

    Hidden assets and other media never count. The recent limit applies after source predicates
    and before content and place filters. An unknown album is empty. The place filter drops
    assets without coordinates, and is skipped unless place lookup is allowed.
    """
    o, out = request.options, assets.where("media_type = 'image' and not is_hidden")
    if o.exclude_favorites:
        out = out.where("not is_favorite")
    if not o.include_screenshots:
        out = out.where("not is_screenshot")
    newest = [F.desc_nulls_last("capture_ts"), "asset_id"]
    match request.scope:
        case DateRange(start, end, exclusive):
            ts = F.col("capture_ts")
            out = out.where((ts >= F.lit(start)) & ((ts < F.lit(end)) if exclusive else (ts <= F.lit(end))))
        case Album(album_id):
            out = out.join(members.where(F.col("album_id") == album_id), "asset_id", "left_semi")
        case Recent(limit):
            out = out.orderBy(*newest).limit(limit)
    if o.content_query:
        out = out.where(matches_content(o.content_query, F.col("labels")))
    if o.location_query and o.location_lookup:
        near = out.where("lat is not null and lon is not null").withColumn("cell", place_key(F.col("lat"), F.col("lon")))
        out = near.join(place_table, "cell", "left").where(matches_place(o.location_query, F.col("fields"))).drop("cell", "fields")
    return out.orderBy(*newest) if in_order else out
