"""Image kernels over many pictures at once: plain loops, odd pictures, and what crosses to Python."""

import numpy as np
import pytest

from lodestone.operators import images
from lodestone.plans.catalog import QUERIES
from tests.test_catalog import SF

PIXEL = "array<struct<r: int, g: int, b: int, a: int>>"


def signature(pixels):
    solid = [p for p in pixels or [] if p and p[3] is not None and p[3] > 0]
    if not solid:
        return None
    bins = [None if None in p[:3] else int(p[0] / 64) * 16 + int(p[1] / 64) * 4 + int(p[2] / 64) for p in solid]
    return [min(255, int(bins.count(i) * 255 / len(solid))) for i in range(64)]


def test_signatures_of_odd_pictures_in_one_pass(spark):
    rng = np.random.default_rng(1)
    given = [None, [], [None], [(1, 2, 3, 0)], [(1, 2, 3, None)], [(None, 2, 3, 255), (255, 255, 255, 1)], [(-70, 0, 0, 255), (-5, 300, 64, 255), (64, 0, 0, 9)]]
    given += [[tuple(map(int, p)) for p in rng.integers(0, 256, (int(n), 4))] for n in rng.integers(0, 300, 50)] * 30
    rows = spark.createDataFrame(list(enumerate(given)), f"i int, p {PIXEL}").coalesce(1).select("i", images.color_signature("p").alias("s"))
    assert [r.s for r in sorted(rows.collect())] == [signature(p) for p in given]
    plan = QUERIES["color_histogram"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan  # no expression that goes over the pixels once a bin


def plain_quality(pixels):
    """One picture by loops over its pixels."""
    if pixels is None or len(pixels) != 4096:
        return (0.5,) * 4
    lum, clip = [[v / 255.0 for v in pixels[r * 64 : r * 64 + 64]] for r in range(64)], sum(v < 4 or v > 251 for v in pixels) / 4096
    flat = [v for row in lum for v in row]
    mean = sum(flat) / 4096
    inner = [4 * lum[y][x] - lum[y][x - 1] - lum[y][x + 1] - lum[y - 1][x] - lum[y + 1][x] for y in range(1, 63) for x in range(1, 63)]
    unit = lambda v: min(1.0, max(0.0, v))
    sharp = unit(sum(v * v for v in inner) / len(inner) * 25)
    return sharp, unit(1 - abs(mean - 0.5) * 1.2 - clip * 0.8), unit((sum((v - mean) ** 2 for v in flat) / 4096) ** 0.5 * 3.2), unit(1 - sharp)


def test_qualities_of_odd_pictures(spark):
    rng = np.random.default_rng(2)
    given = [None, [], [1], [0] * 4096, [255] * 4096, [i % 64 * 4 for i in range(4096)]]
    given += [(x + rng.integers(0, 9, 4096)).tolist() for x in range(0, 240, 10)] + [[1] * 4097]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, p array<int>").coalesce(1).select("i", images.quality_metrics("p").alias("q"))
    for r in rows.collect():
        assert tuple(r.q) == pytest.approx(plain_quality(given[r.i]), abs=1e-10)
    missing = spark.createDataFrame([(1, [None] + [9] * 4095)], "i int, p array<int>").select(images.quality_metrics("p").alias("q")).first().q
    assert tuple(missing) == (0.0, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("name", ["quality_metrics", "color_histogram"])
def test_no_pixels_between_spark_and_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambda" not in plan
    assert plan.count("drawn(") == 1


def test_drawn_as_gray(spark):
    from pyspark.sql import functions as F

    from lodestone.plans import catalog

    rows = spark.createDataFrame([(k, s, v) for k, (s, v) in enumerate([(0, 0), (1, 3), (10**12, 2), (-1, 0), (-7, -3), (-8, 1)] * 9)], "asset_id long, scene long, variant long")
    both = catalog.gray(rows, 300).join(catalog.pictures(rows, 300).select("asset_id", F.col("pixels").alias("other")), "asset_id").collect()
    assert len(both) == 54 and all(r.pixels == r.other for r in both)
