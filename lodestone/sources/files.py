"""Picture files: gray levels of simple bitmaps, and the altitude in a JPEG's EXIF block."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed values of the EXIF format: the GPS block's pointer, altitude and its reference.
GPS_BLOCK, ALTITUDE_REF, ALTITUDE = 0x8825, 5, 6
#: The longer side of a face's picture at most.
FACE_SIDE = 1024


def gray_levels(content: bytes, side: int = 64) -> list[int] | None:
    """Gray levels of a binary PGM or PPM, taken at the nearest places of a square; else None."""
    gray = bitmap(content)
    if gray is None:
        return None
    h, w = gray.shape
    rows, columns = np.arange(side) * h // side, np.arange(side) * w // side
    return gray[rows][:, columns].ravel().tolist()


def bitmap(content: bytes) -> np.ndarray | None:
    """Gray levels, line by line, of a binary PGM or PPM with 255 levels; else None."""
    parts = content.split(maxsplit=4) if content[:2] in (b"P5", b"P6") else []
    try:
        kind, w, h, most = parts[0], int(parts[1]), int(parts[2]), int(parts[3])
        depth = 1 if kind == b"P5" else 3
        data = np.frombuffer(content[-w * h * depth :], np.uint8).reshape(h, w, depth).astype(np.float64)
    except (IndexError, ValueError):
        return None
    if most != 255 or not w * h:
        return None
    gray = data[:, :, 0] if depth == 1 else data @ np.array([0.299, 0.587, 0.114])
    return gray.round().astype(np.int32)


def crop_levels(content: bytes, x: float, y: float, w: float, h: float, side: int = FACE_SIDE) -> tuple[int, int, list[int]] | None:
    """(width, height, gray levels) of a rectangle of a picture, made smaller to fit a square if need be; else None."""
    gray = bitmap(content)
    if gray is None:
        return None
    part = gray[max(0, round(y)) : max(0, round(y + h)), max(0, round(x)) : max(0, round(x + w))]
    if not part.size:
        return None
    by = max(1.0, max(part.shape) / side)
    rows, columns = (np.minimum(np.arange(max(1, int(n / by))) * by, n - 1).astype(int) for n in part.shape)
    return len(columns), len(rows), part[rows][:, columns].ravel().tolist()


def exif_altitude(content: bytes) -> float | None:
    """Metres above sea level (below: negative); None if there is none or the block is broken."""
    at = content.find(b"Exif\0\0")
    if at < 0:
        return None
    tiff = content[at + 6 :]
    try:
        order = {b"II": "<", b"MM": ">"}[tiff[:2]]

        def block(start: int) -> dict[int, bytes]:
            (n,) = struct.unpack_from(order + "H", tiff, start)
            return {struct.unpack_from(order + "H", tiff, e)[0]: tiff[e : e + 12] for e in range(start + 2, start + 2 + 12 * n, 12)}

        gps = block(struct.unpack(order + "I", block(struct.unpack_from(order + "I", tiff, 4)[0])[GPS_BLOCK][8:])[0])
        a, b = struct.unpack_from(order + "II", tiff, struct.unpack(order + "I", gps[ALTITUDE][8:])[0])
        below = ALTITUDE_REF in gps and gps[ALTITUDE_REF][8] == 1
        return None if not b else -a / b if below else a / b
    except (KeyError, struct.error, IndexError):
        return None


CROP = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("pixels", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(CROP)
def crop_pixels(content: pd.Series, box: pd.DataFrame) -> pd.DataFrame:
    found = [crop_levels(bytes(c), *b) if c is not None and not any(v is None or v != v for v in b) else None for c, b in zip(content, box[["x", "y", "w", "h"]].itertuples(index=False), strict=True)]
    return pd.DataFrame([x or (None, None, None) for x in found], columns=CROP.names)


def face_pictures(files: DataFrame, faces: DataFrame) -> DataFrame:
    """path, face: the picture of each face's rectangle (struct<width, height, pixels>, null if it can't be read).

    ``files``: path, content; ``faces``: path, crop (a rectangle in pixels, as ``images.face_crop`` gives it).
    Files without a face are never decoded.
    """
    there = faces.where("crop is not null").select("path", "crop")
    return files.select("path", "content").join(there, "path").select("path", crop_pixels("content", "crop").alias("face"))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def gray_pixels(content: pd.Series) -> pd.Series:
    return content.map(lambda c: gray_levels(bytes(c)) if c is not None else None)


@F.pandas_udf(T.DoubleType())
def altitude_of(content: pd.Series) -> pd.Series:
    return content.map(lambda c: exif_altitude(bytes(c)) if c is not None else None)


def pictures(spark: SparkSession, path: str) -> DataFrame:
    """path, pixels (64 x 64 gray levels or null), altitude (or null) of each file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", gray_pixels("content").alias("pixels"), altitude_of("content").alias("altitude"))
