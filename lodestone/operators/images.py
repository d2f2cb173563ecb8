"""Kernels over small pixel arrays, as Arrow UDFs over many pictures at once and as SQL expressions where those do."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDE = 64


#: Pictures that a kernel takes at once: their intermediate values stay in a core's cache.
AT_ONCE = 8


def qualities(pixels: np.ndarray) -> np.ndarray:
    """Rows (sharpness, exposure, contrast, motion blur), each within 0 and 1, of rows of 64 x 64 gray levels."""
    flat = pixels.astype(np.float64)
    p, n = flat.reshape(-1, SIDE, SIDE), SIDE * SIDE
    inner = p[:, 1:-1, 1:-1] * 4
    for side in (p[:, 1:-1, :-2], p[:, 1:-1, 2:], p[:, :-2, 1:-1], p[:, 2:, 1:-1]):
        inner -= side
    inner = inner.reshape(len(p), -1)
    total, squares = flat.sum(axis=1), np.einsum("ij,ij->i", flat, flat)
    clipped = np.count_nonzero((flat < 4) | (flat > 251), axis=1) / n
    unit = lambda x: np.clip(np.nan_to_num(x, nan=0.0), 0.0, 1.0)
    sharp = unit(np.einsum("ij,ij->i", inner, inner) / inner.shape[1] / 255.0**2 * 25)
    spread = np.sqrt(np.maximum(0.0, squares * n - total * total)) / n / 255.0  # sums of whole levels are exact
    return np.stack([sharp, unit(1.0 - abs(total / n / 255.0 - 0.5) * 2 * 0.6 - clipped * 0.8), unit(spread * 3.2), unit(1.0 - sharp)], axis=1)


def quality(pixels: np.ndarray) -> tuple[float, float, float, float]:
    """What ``qualities`` has for one picture."""
    return tuple(qualities(pixels.reshape(1, -1))[0].tolist())


QUALITY = T.StructType([T.StructField(c, T.DoubleType()) for c in ("sharpness", "exposure", "contrast", "motion_blur")])


@F.arrow_udf(QUALITY)
def quality_metrics(pixels: pa.Array) -> pa.Array:
    """One half each where there is no picture of the right size."""
    whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(pixels), SIDE * SIDE), False))
    some = pixels if whole.all() else pixels.filter(pa.array(whole))
    levels = pc.list_flatten(some).to_numpy(zero_copy_only=False).reshape(-1, SIDE * SIDE)
    out = np.full((len(pixels), len(QUALITY)), 0.5)
    if len(levels):
        out[whole] = np.concatenate([qualities(levels[i : i + AT_ONCE]) for i in range(0, len(levels), AT_ONCE)])
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in out.T], names=QUALITY.names)


def dhash(pixels: Column) -> Column:
    """64 bits of 9 x 8 gray levels, row by row from the lowest bit: set where the left one is brighter."""
    left = lambda i: F.get(pixels, (i / 8).cast("int") * 9 + i % 8)
    right = lambda i: F.get(pixels, (i / 8).cast("int") * 9 + i % 8 + 1)
    one = F.lit(1).cast("long")
    bit = lambda i: F.when(left(i) > right(i), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))
    return F.when(F.size(pixels) == 72, F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(63)), bit), F.lit(0).cast("long"), lambda s, b: s.bitwiseOR(b)))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def color_signature(pixels: pa.Array) -> pa.Array:
    """64 bins of the top two bits of red, green and blue, as shares of 255; clear pixels don't count.

    Pixels are structs of r, g, b and a. Each is looked at once, however many bins there are. A pixel
    with a missing colour counts in no bin; without pixels that count the signature is null.
    """
    counts, totals = np.zeros((len(pixels), 64), np.int64), np.zeros(len(pixels), np.int64)
    for i in range(0, len(pixels), 64 * AT_ONCE):
        some = pixels.slice(i, 64 * AT_ONCE)
        row, flat = np.asarray(pc.list_parent_indices(some)), pc.list_flatten(some)
        r, g, b, a = (pc.struct_field(flat, c).to_numpy(zero_copy_only=False) for c in "rgba")
        solid = a > 0
        red, green, blue = (np.trunc(c[solid] / 64) for c in (r, g, b))
        row, bins = row[solid], red * 16 + green * 4 + blue
        totals[i : i + len(some)] = np.bincount(row, minlength=len(some))
        row, bins = row[known := (bins >= 0) & (bins < 64)], bins[known].astype(np.int64)
        counts[i : i + len(some)] = np.bincount(row * 64 + bins, minlength=64 * len(some)).reshape(-1, 64)
    shares = np.minimum(255, (counts * 255 / np.maximum(totals, 1)[:, None]).astype(np.int32))
    ends = pa.array(np.arange(len(pixels) + 1, dtype=np.int32) * 64)
    return pa.ListArray.from_arrays(ends, pa.array(shares.ravel().astype(np.int32)), mask=pa.array(totals == 0))


def largest_faces(faces: Column, most: int = 4) -> Column:
    """The largest boxes (struct<x, y, w, h>) by area, largest first."""
    area = lambda f: f["w"] * f["h"]
    return F.slice(F.array_sort(faces, lambda a, b: F.when(area(a) > area(b), -1).when(area(a) < area(b), 1).otherwise(0)), 1, most)


def face_crop(box: Column, width: Column, height: Column, pad: float = 0.2, least: int = 8) -> Column:
    """Pixel rectangle of a unit box with its origin below: flipped, padded, clamped; null if tiny."""
    w, h = box["w"] * width, box["h"] * height
    x, y = box["x"] * width - w * pad, (1 - box["y"] - box["h"]) * height - h * pad
    x0, y0 = F.greatest(F.lit(0.0), x), F.greatest(F.lit(0.0), y)
    x1, y1 = F.least(width, x + w * (1 + 2 * pad)), F.least(height, y + h * (1 + 2 * pad))
    return F.when((x1 - x0 >= least) & (y1 - y0 >= least), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))
