"""Names and types shared by all plans."""

from __future__ import annotations

from pyspark.sql import types as T

# The seven reported descriptors, in reporting order.
METRICS = (
    "length",
    "tortuosity",
    "max_curvature",
    "mean_abs_curvature",
    "total_abs_turning",
    "total_abs_turning_per_length",
    "local_dir_change_per_length",
)

VERTEX = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("filament_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
    ]
)

PER_IMAGE = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("patient_id", T.StringType()),
        T.StructField("filament_id", T.StringType()),
        *[T.StructField(m, T.DoubleType()) for m in METRICS],
        T.StructField("n_points", T.IntegerType()),
    ]
)

PER_PATIENT = T.StructType(
    [
        T.StructField("patient_id", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("n", T.LongType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("sd", T.DoubleType()),
        T.StructField("ci95_low", T.DoubleType()),
        T.StructField("ci95_high", T.DoubleType()),
    ]
)

# One tile of a raster: (ty, tx) is its place in the tile grid, (y0, x0) its
# top-left pixel, (h, w) its own size, (height, width) the whole image. Pixels
# are row major; float32 for maps, uint8 for masks.
TILE = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("ty", T.IntegerType()),
        T.StructField("tx", T.IntegerType()),
        T.StructField("y0", T.IntegerType()),
        T.StructField("x0", T.IntegerType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixels", T.BinaryType()),
    ]
)
