"""Small drawn fixtures with known answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators.curves import block_of
from strandflow.operators.tiles import cut_tiles, map_tiles


def points_df(spark: SparkSession, curves: dict, image: str = "img") -> DataFrame:
    """{filament: array of (x, y)} to long form with seq, n and block."""
    rows = [
        (image, str(k), i, len(p), float(x), float(y))
        for k, p in curves.items()
        for i, (x, y) in enumerate(np.asarray(p, dtype=float))
    ]
    df = spark.createDataFrame(rows, "image_id string, filament_id string, seq long, n long, x double, y double")
    return df.withColumn("block", block_of(F.col("seq")))


def float_tiles(spark: SparkSession, images: dict[str, np.ndarray], tile: int) -> DataFrame:
    rows = [
        (k, a.shape[0], a.shape[1], np.asarray(a, dtype=np.float32).ravel().tolist())
        for k, a in images.items()
    ]
    df = spark.createDataFrame(rows, "image_id string, height int, width int, px array<float>")
    return cut_tiles(df, tile=tile)


def bool_tiles(spark: SparkSession, images: dict[str, np.ndarray], tile: int) -> DataFrame:
    return map_tiles(float_tiles(spark, images, tile), lambda a, _: (a > 0).astype(np.uint8))


def draw(shape: tuple[int, int], lines: list, width: int = 5) -> np.ndarray:
    """Thick straight lines ((x0, y0), (x1, y1)) on an empty mask."""
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    out = np.zeros(shape, dtype=bool)
    for (x0, y0), (x1, y1) in lines:
        length = np.hypot(x1 - x0, y1 - y0)
        t = np.clip(((xx - x0) * (x1 - x0) + (yy - y0) * (y1 - y0)) / length**2, 0, 1)
        out |= np.hypot(xx - x0 - t * (x1 - x0), yy - y0 - t * (y1 - y0)) <= width / 2
    return out


def assemble(tiles: DataFrame, shape: tuple[int, int], dtype: type = np.float32) -> np.ndarray:
    out = np.zeros(shape, dtype=dtype)
    for r in tiles.collect():
        out[r.y0 : r.y0 + r.h, r.x0 : r.x0 + r.w] = np.frombuffer(r.pixels, dtype=dtype).reshape(r.h, r.w)
    return out


def polylines(df: DataFrame, key: str = "curve") -> dict:
    out: dict = {}
    for r in df.orderBy("image_id", key, "seq").collect():
        out.setdefault((r["image_id"], r[key]), []).append((r["x"], r["y"]))
    return {k: np.asarray(v) for k, v in out.items()}


def lengths(df: DataFrame, key: str = "curve") -> dict[str, list[float]]:
    found: dict[str, list[float]] = {}
    for (image, _), p in polylines(df, key).items():
        found.setdefault(image, []).append(float(np.hypot(*np.diff(p, axis=0).T).sum()))
    return {k: sorted(v) for k, v in found.items()}
