"""The nearest of many places to each of many points on a sphere, by equality joins alone.

Points and places are unit vectors in a grid of cubes, so poles and the date line are nothing special.
A point meets the places of its cube and the 26 around it. Whatever lies outside of these is further
than a cube's side, so a place within a side is proven to be the nearest. Points without one go on to
cubes twice as large, until one round settles all: a side of two spans the sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import similarity as S
from lodestone.sources.tables import cut

#: Side of the first cubes, in units of the radius: about 1.6 km on the earth.
SIDE = 1 / 4096


def _vector(lat: Column, lon: Column) -> Column:
    y, x = F.radians(lat), F.radians(lon)
    return F.struct((F.cos(y) * F.cos(x)).alias("x"), (F.cos(y) * F.sin(x)).alias("y"), F.sin(y).alias("z"))


def _cube(v: Column, side: float) -> Column:
    return F.struct(*[F.floor(v[c] / side).alias(c) for c in "xyz"])


def _around(cube: Column) -> Column:
    """A cube and the 26 that touch it."""
    steps = F.array(*[F.lit(i).cast("long") for i in (-1, 0, 1)])
    return F.flatten(F.flatten(F.transform(steps, lambda i: F.transform(steps, lambda j: F.transform(steps, lambda k: F.struct((cube["x"] + i).alias("x"), (cube["y"] + j).alias("y"), (cube["z"] + k).alias("z")))))))


def nearest(points: DataFrame, places: DataFrame, place: str = "place_id", side: float = SIDE) -> DataFrame:
    """lat, lon, place, meters of each different coordinate of ``points``: the nearest of ``places`` (place, lat, lon).

    Of places at the same distance the smallest name counts; equal coordinates are asked for once, so a
    much photographed spot is one point. Coordinates with a null or NaN, on either side, are left out, and
    without places the result is empty. A round's join is by cube: only points far from all places meet large ones.
    """
    known = lambda rows: rows.where("not isnan(lat) and not isnan(lon) and lat is not null and lon is not null")
    open_ = cut(known(points).select(F.col("lat").cast("double"), F.col("lon").cast("double")).distinct().withColumn("v", _vector(F.col("lat"), F.col("lon"))))
    table = known(places).select(F.col(place).alias("__place"), F.col("lat").cast("double").alias("__lat"), F.col("lon").cast("double").alias("__lon"))
    table = cut(table.groupBy("__lat", "__lon").agg(F.min("__place").alias("__place")).withColumn("__v", _vector(F.col("__lat"), F.col("__lon"))))
    found = None
    while True:
        last = side >= 2
        near = open_.select("lat", "lon", "v", F.explode(_around(_cube(F.col("v"), side))).alias("cube")).join(table.withColumn("cube", _cube(F.col("__v"), side)), "cube")
        gap = sum(((F.col("v")[c] - F.col("__v")[c]) * (F.col("v")[c] - F.col("__v")[c]) for c in "xyz"), F.lit(0.0))
        near = near.where(F.lit(last) | (gap <= (side * (1 - 1e-9)) ** 2))  # a larger distance proves nothing
        meters = S.meters(F.col("lat"), F.col("lon"), F.col("__lat"), F.col("__lon"))
        # rounded to a micrometre, so that equal distances are equal whatever the arithmetic
        best = near.groupBy("lat", "lon").agg(F.min(F.struct(F.round(meters, 6).alias("meters"), F.col("__place").alias(place))).alias("best"))
        best = cut(best.select("lat", "lon", f"best.{place}", "best.meters"))
        found = best if found is None else found.union(best)
        if last:
            return found
        open_ = cut(open_.join(best.select("lat", "lon"), ["lat", "lon"], "left_anti"))
        if not open_.head(1):
            return found
        side = 2.0 if side >= 1 else min(2 * side, 2.0)


def rounds(side: float = SIDE) -> int:
    """How many rounds there are at most."""
    return 1 + math.ceil(math.log2(2 / side))
