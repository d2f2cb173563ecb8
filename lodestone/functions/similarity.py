"""Scalar and pair expressions: keys, distances, similarity predicates, quality and protection."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
SAME_SESSION_S, SAME_SESSION_M = 600.0, 60.0
FACE_DISTANCE, COLOR_SIMILARITY, PREFILTER_BITS = 0.55, 0.6, 22


@dataclass(frozen=True)
class Sensitivity:
    strict: float
    relaxed: float
    groups_poses: bool


#: Thresholds of the three matching modes.
SENSITIVITIES = {
    "conservative": Sensitivity(0.30, 0.50, False),
    "balanced": Sensitivity(0.55, 0.88, False),
    "aggressive": Sensitivity(0.80, 0.92, True),
}


def blocking_key(ts: Column, width: Column, height: Column, screenshot: Column) -> Column:
    """Day of the year (UTC) or nodate, tenths of the aspect ratio, screenshot or photo."""
    day = F.coalesce(F.date_format(ts, "yyyy-DDD"), F.lit("nodate"))
    aspect = F.when(height > 0, (width.cast("double") / F.when(height > 0, height) * 10).cast("int")).otherwise(0)
    return F.concat(day, F.lit("|"), aspect.cast("string"), F.lit("|"), F.when(screenshot, "s").otherwise("p"))


#: Compares two prints or vectors; null where it can't.
Distance = Callable[[Column, Column], Column]


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean; null if either is missing or their sizes differ."""
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)))


def pair_distance(fa: Column, fb: Column, ha: Column, hb: Column) -> Column:
    """Feature distance, else differing bits by 64."""
    return F.coalesce(vector_distance(fa, fb), hamming(ha, hb) / F.lit(64.0))


def face_distances(a: Column, b: Column) -> tuple[Column, Column]:
    """(smaller side, larger side) of two sets of prints; the left one of equal sizes is the smaller."""
    less = F.size(a) <= F.size(b)
    return F.when(less, a).otherwise(b), F.when(less, b).otherwise(a)


def _nearest(fewer: Column, more: Column, distance: Distance = vector_distance) -> Column:
    far = F.lit(3.4e38)
    return F.transform(fewer, lambda f: F.array_min(F.transform(more, lambda g: F.coalesce(distance(f, g), far))))


def face_sets_match(a: Column, b: Column, threshold: float = FACE_DISTANCE, distance: Distance = vector_distance) -> Column:
    """Each face of the smaller set has one within the threshold; of equal sizes the left set counts.

    ``distance`` compares two prints of whatever type; null is further than any threshold.
    """
    return F.forall(_nearest(*face_distances(a, b), distance), lambda d: d <= threshold)


def worst_face_match(a: Column, b: Column) -> Column:
    """Largest of the smaller side's nearest distances; null if either set is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.array_max(_nearest(*face_distances(a, b))))


def same_people(na: Column, nb: Column, a: Column, b: Column, distance: Distance = vector_distance) -> Column:
    """Equal counts of faces, and matching prints where there are faces; missing prints never match."""
    return F.when(na != nb, F.lit(False)).when(na == 0, F.lit(True)).when((F.size(a) == 0) | (F.size(b) == 0), F.lit(False)).otherwise(face_sets_match(a, b, distance=distance))


def color_similarity(a: Column, b: Column) -> Column:
    """Shared histogram mass by the smaller total; null if missing, unequal, empty or zero."""
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, v: s + v)
    least = F.least(total(a), total(b))
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda s, v: s + v)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (least > 0), shared / F.nullif(least, F.lit(0)))


def similar_color(a: Column, b: Column) -> Column:
    return F.coalesce(color_similarity(a, b) >= COLOR_SIMILARITY, F.lit(True))


def meters(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    s = F.sin(dlat / 2) * F.sin(dlat / 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon / 2) * F.sin(dlon / 2)
    return F.lit(EARTH_M) * 2 * F.atan2(F.sqrt(s), F.sqrt(1 - s))


def seconds(a: Column, b: Column) -> Column:
    """a - b."""
    return (F.unix_micros(a) - F.unix_micros(b)) / F.lit(1e6)


def same_session(ta: Column, tb: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Both dated, within ten minutes, and within 60 m if both have coordinates."""
    near = F.coalesce(meters(lat1, lon1, lat2, lon2) <= SAME_SESSION_M, F.lit(True))
    return F.coalesce(F.abs(seconds(ta, tb)) <= SAME_SESSION_S, F.lit(False)) & near


def location_bucket(lat: Column, lon: Column, places: int = 4) -> Column:
    """Rounded coordinates as text; null if either is missing."""
    return F.when(lat.isNotNull() & lon.isNotNull(), F.format_string(f"%.{places}f,%.{places}f", F.round(lat, places), F.round(lon, places)))


#: Protection reasons in their order, and the flag of each.
REASONS = {"favorite": "is_favorite", "edited": "is_edited", "livePhoto": "is_live", "hidden": "is_hidden", "shared": "is_shared", "hasPeople": "has_people"}


def protection_reasons(off: tuple[str, ...] = ()) -> Column:
    """Reasons that hold for a row, in order; ``off`` names reasons the policy doesn't use."""
    return F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in REASONS.items() if name not in off]))


def quality_score(most_pixels: Column) -> Column:
    """Weighted score of a member; pixels count by the group's most."""
    face = F.when(F.col("has_people"), F.least(F.lit(1.0), 0.5 + F.col("face_count") * 0.1)).otherwise(0.0)
    held = F.when(F.col("is_favorite") | F.col("is_edited"), 1.0).otherwise(0.0)
    pixels = F.when(most_pixels > 0, F.col("pixel_count").cast("double") / F.nullif(most_pixels, F.lit(0))).otherwise(0.0)
    return 0.30 * F.col("sharpness") + 0.20 * F.col("exposure") + 0.15 * pixels + 0.10 * face + 0.10 * held + 0.10 * F.col("contrast") + F.lit(0.05)


def hundredths(x: Column) -> Column:
    """Rounded to two places, halves up (scores aren't negative)."""
    return F.floor(x * 100 + 0.5) / F.lit(100.0)


def percent(x: Column, spoken: bool = True) -> Column:
    """Whole percent: rounded where spoken, cut off where shown."""
    return F.floor(x * 100 + (0.5 if spoken else 0.0)).cast("int")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


ALTITUDE_M, LOCATION_M, ASPECT = 8.0, 30.0, 0.3


def unique_angle(alt: Column, keeper_alt: Column, lat: Column, lon: Column, keeper_lat: Column, keeper_lon: Column, aspect: Column, keeper_aspect: Column) -> Column:
    """A different altitude, position or framing than the keeper's; a missing value decides nothing."""
    parts = [
        F.abs(alt - keeper_alt) >= ALTITUDE_M,
        meters(lat, lon, keeper_lat, keeper_lon) >= LOCATION_M,
        (aspect > 0) & (keeper_aspect > 0) & (F.abs(aspect - keeper_aspect) >= ASPECT),
    ]
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def altitude(value: Column, ref: Column) -> Column:
    """Metres above sea level from a tag and its reference (1: below); null without a value."""
    return F.when(ref == 1, -value).otherwise(value)
