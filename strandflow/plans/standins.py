"""Curves and rasters read from the general-purpose tables.

The tables hold no fibrils. These views give the operators ordered points and
small images with known keys, so results can be compared with another engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.operators.curves import Layout, explode_points
from strandflow.session import spread, whole

# The first day of ``events``, and a day in microseconds.
EPOCH = "2024-01-01"
DAY_US = 86_400_000_000

V1 = Layout(keys=("image_id", "filament_id"), order=("us",))
V2 = Layout(
    keys=("image_id", "filament_id"),
    order=("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"),
)
V3 = Layout(keys=("patient_id", "filament_id"), order=("seq",))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def curves_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V1: a user's events in time order; x in hours, y the value. Blocks are days."""
    ts = F.col("ts")
    # Wall-clock fields, so the session's time zone plays no part.
    us = (
        F.datediff(F.to_date(ts), F.lit(EPOCH).cast("date")).cast("long") * DAY_US
        + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000
        + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )
    image = F.col("user_id") % 30
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("filament_id"),
        image.alias("image_id"),
        (image % 5).alias("patient_id"),
        us.alias("us"),
        (us / F.lit(3.6e9)).alias("x"),
        F.col("value").alias("y"),
        F.floor(us / F.lit(DAY_US)).cast("long").alias("block"),
    )


def curves_orders(spark: SparkSession, sf_dir: str, *, x: Column | None = None, y: Column | None = None) -> DataFrame:
    """V2: an order's lines; image = customer, patient = nation. Blocks cut by line and part.

    An order has a handful of lines, so lines are dealt by order once, in parts of a fixed
    number of rows; the join and all that is done per curve keep that partitioning.
    """
    line, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    customer = table(spark, sf_dir, "customer")
    keys = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        "o_orderkey", "o_custkey", "c_nationkey"
    )
    line = spread(line.select("l_orderkey", *V2.order), "l_orderkey", rows=line.count())
    return line.join(whole(keys), line.l_orderkey == keys.o_orderkey).select(
        F.col("l_orderkey").alias("filament_id"),
        F.col("o_custkey").alias("image_id"),
        F.col("c_nationkey").alias("patient_id"),
        *[F.col(c) for c in V2.order],
        (x if x is not None else F.col("l_quantity")).alias("x"),
        (y if y is not None else F.col("l_extendedprice") / 1000).alias("y"),
        (F.col("l_linenumber").cast("long") * (1 << 32) + F.floor(F.col("l_partkey") / 4096)).alias("block"),
    )


def curves_arrays(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """V3, array form: the 64 numbers are 32 (x, y) vertices; patient = label. ``rows``: of some embeddings only."""
    e = table(spark, sf_dir, "embeddings") if rows is None else rows
    at = lambda i: F.element_at("embedding", i.cast("int")).cast("double")
    points = F.transform(
        F.sequence(F.lit(0), F.lit(31)),
        lambda k: F.struct(at(k * 2 + 1).alias("x"), at(k * 2 + 2).alias("y")),
    )
    return e.select(
        F.col("vec_id").alias("filament_id"), F.col("label").alias("patient_id"), points.alias("points")
    )


def curves_vec(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """V3, long form."""
    return explode_points(curves_arrays(spark, sf_dir, rows), ["patient_id", "filament_id"])


def curves_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V3 laid out on a plane, two neighbours per site, so that most pairs are far apart."""
    c = curves_vec(spark, sf_dir)
    site = F.floor(F.col("filament_id") / 2)
    return c.select(
        F.col("patient_id").alias("image_id"),
        "filament_id",
        "seq",
        (F.col("x") + F.lit(0.4) * (site % 8)).alias("x"),
        (F.col("y") + F.lit(0.4) * F.floor(site / 8)).alias("y"),
        "block",
    )


def chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """V4: the same 64 numbers as an 8 x 8 raster."""
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.lit(8).alias("height"),
        F.lit(8).alias("width"),
        F.col("embedding").alias("px"),
    )
