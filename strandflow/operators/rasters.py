"""Raster operators in plain DataFrame form.

Two layouts: *chips*, small rasters in one row (``px array<float>`` row major
with ``height``/``width``), worked on inside the row; and *pixels*, one row per
(image, y, x), for masks and for blending, where only set pixels exist. Whole
micrographs are tiles (see ``tiles``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.expr import ratio

# ---------------------------------------------------------------- chips


def _at_rank(ordered: Column, p: float) -> Column:
    at = F.lit(float(p)) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    a = F.element_at(ordered, low + 1)
    b = F.element_at(ordered, F.least(low + 2, F.size(ordered)))
    return a + (at - low) * (b - a)


def quantile_of(px: Column, p: float) -> Column:
    """Linear-interpolated quantile of a non-empty array, without a shuffle."""
    return let(F.array_sort(F.transform(px, lambda v: v.cast("double"))), lambda o: _at_rank(o, p))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A plain column would be inlined into lambda bodies and recomputed for every
    array element; a lambda variable is not.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def clip01(v: Column) -> Column:
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))


def normalize_percentile(
    px: Column, low: float = 0.01, high: float = 0.99, *, eps: float | None = None
) -> Column:
    """Clip to the given quantiles and scale to [0, 1]; flat rasters become zeros.

    ``eps`` selects the variant used for matching and overlays: it is added to
    the denominator and there is no branch for flat rasters.
    """

    def scale(q: Column) -> Column:
        span = q["high"] - q["low"]
        if eps is not None:
            return F.transform(px, lambda v: clip01((v.cast("double") - q["low"]) / (span + F.lit(eps))))
        return F.transform(
            px,
            lambda v: F.when(span > 0, clip01((v.cast("double") - q["low"]) / span)).otherwise(0.0),
        )

    bounds = let(
        F.array_sort(F.transform(px, lambda v: v.cast("double"))),
        lambda o: F.struct(_at_rank(o, low).alias("low"), _at_rank(o, high).alias("high")),
    )
    return let(bounds, scale)


def min_max_scale(px: Column, *, invert: bool = False) -> Column:
    bounds = F.struct(F.array_min(px).alias("low"), F.array_max(px).alias("high"))

    def scale(b: Column) -> Column:
        span = b["high"] - b["low"] + F.lit(1e-9)
        return F.transform(
            px,
            lambda v: (F.lit(1.0) - (v - b["low"]) / span) if invert else (v - b["low"]) / span,
        )

    return let(bounds, scale)


def standardize(px: Column) -> Column:
    """Zero mean, unit population deviation (1e-9 guards a flat raster)."""
    zero = F.lit(0.0)
    mean = F.aggregate(px, zero, lambda s, v: s + v) / F.size(px)

    def spread(m: Column) -> Column:
        var = F.aggregate(px, zero, lambda s, v: s + (v - m) * (v - m)) / F.size(px)
        return F.struct(m.alias("mean"), (F.sqrt(var) + F.lit(1e-9)).alias("sd"))

    return let(let(mean, spread), lambda z: F.transform(px, lambda v: (v - z["mean"]) / z["sd"]))


def to_pixels(chips: DataFrame, keys: Sequence[str], px: str = "px") -> DataFrame:
    return chips.select(*keys, "width", F.posexplode(px).alias("k", "v")).select(
        *keys,
        F.floor(F.col("k") / F.col("width")).cast("int").alias("y"),
        (F.col("k") % F.col("width")).cast("int").alias("x"),
        F.col("v").cast("double").alias("v"),
    )


def block_average(chips: DataFrame, keys: Sequence[str], factor: int, px: str = "px") -> DataFrame:
    """Mean of factor x factor blocks; a ragged right or bottom edge is dropped."""
    if factor < 1:
        raise ValueError(f"cannot average blocks of {factor} pixels")
    sized = chips.select(*keys, "height", "width", F.posexplode(px).alias("k", "v"))
    y, x = F.floor(F.col("k") / F.col("width")), F.col("k") % F.col("width")
    return (
        sized.select(
            *keys,
            F.floor(y / factor).cast("int").alias("by"),
            F.floor(x / factor).cast("int").alias("bx"),
            F.floor(F.col("height") / factor).alias("nby"),
            F.floor(F.col("width") / factor).alias("nbx"),
            F.col("v").cast("double").alias("v"),
        )
        .filter((F.col("by") < F.col("nby")) & (F.col("bx") < F.col("nbx")))
        .groupBy(*keys, "by", "bx")
        .agg(F.avg("v").alias("v"))
    )


def mask_overlap(pred: Column, truth: Column, ignore: Column) -> Column:
    """Dice and IoU of two boolean arrays, inside and regardless of ``ignore``.

    Both are always reported: the ignore mask covers exactly where a detector
    over-predicts, so the restricted score flatters it and the other punishes it.
    """
    triples = F.arrays_zip(pred.alias("p"), truth.alias("t"), ignore.alias("g"))

    def count(test) -> Column:
        return F.size(F.filter(triples, test))

    n = F.size(pred)
    p, t = count(lambda z: z["p"]), count(lambda z: z["t"])
    both, either = count(lambda z: z["p"] & z["t"]), count(lambda z: z["p"] | z["t"])
    pl = count(lambda z: z["p"] & ~z["g"])
    tl = count(lambda z: z["t"] & ~z["g"])
    both_l = count(lambda z: z["p"] & z["t"] & ~z["g"])
    either_l = count(lambda z: (z["p"] | z["t"]) & ~z["g"])
    return F.struct(
        overlap_ratio(both_l * 2, pl + tl).alias("dice_labelled"),
        overlap_ratio(both * 2, p + t).alias("dice_all_pixels"),
        overlap_ratio(both_l, either_l).alias("iou"),
        overlap_ratio(both, either).alias("iou_all_pixels"),
        ratio(count(lambda z: z["g"]), n).alias("ignored_fraction"),
        ratio(p, n).alias("predicted_fraction"),
        ratio(t, n).alias("mask_fraction"),
    )


def overlap_ratio(num: Column, den: Column) -> Column:
    """1.0 when both masks are empty."""
    return F.coalesce(ratio(num, den), F.lit(1.0))


# ---------------------------------------------------------------- tiling


def tile_starts(extent: Column, patch: int, overlap: int) -> Column:
    """Start offsets along one axis; the last tile is pulled flush with the edge."""
    if overlap >= patch:
        raise ValueError(f"tiles of {patch} cannot share {overlap} pixels")
    last = extent - F.lit(patch)
    return F.when(extent <= patch, F.array(F.lit(0))).otherwise(
        F.array_union(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(patch - overlap)), F.array(last))
    )


def tile_positions(images: DataFrame, patch: int, overlap: int) -> DataFrame:
    """One row per tile corner (y, x); ``images`` has integer height and width."""
    return images.select(
        "*", F.explode(tile_starts(F.col("height"), patch, overlap)).alias("y")
    ).select("*", F.explode(tile_starts(F.col("width"), patch, overlap)).alias("x"))


def blend_weight(k: Column, patch: int, taper: float = 0.25) -> Column:
    """One axis of the raised-cosine window: 1 in the middle, falling to the border."""
    ramp = max(int(round(patch * taper)), 1)
    rise = (F.lit(1.0) - F.cos(F.pi() * (F.least(k, F.lit(patch - 1) - k) + 1) / F.lit(ramp + 1.0))) / 2
    return F.when(F.least(k, F.lit(patch - 1) - k) < ramp, rise).otherwise(F.lit(1.0))


def extract_patches(chips: DataFrame, keys: Sequence[str], patch: int, overlap: int, px: str = "px") -> DataFrame:
    """Patches as rows: ``y, x`` corner and ``px`` of patch x patch values.

    Chips smaller than the patch are returned at their own size.
    """
    rows = F.sequence(F.lit(0), F.least(F.lit(patch), F.col("height")) - 1)
    cut = F.flatten(
        F.transform(
            rows,
            lambda r: F.slice(
                F.col(px),
                (F.col("y") + r) * F.col("width") + F.col("x") + 1,
                F.least(F.lit(patch), F.col("width")),
            ),
        )
    )
    return tile_positions(chips, patch, overlap).select(
        *keys, "height", "width", "y", "x", cut.alias("px")
    )


def stitch(patches: DataFrame, keys: Sequence[str], patch: int, px: str = "px") -> DataFrame:
    """Blend overlapping patches into one map: weighted mean per pixel."""
    side = F.lit(patch)
    r, c = F.floor(F.col("k") / side).cast("int"), (F.col("k") % side).cast("int")
    weight = F.greatest(blend_weight(r, patch) * blend_weight(c, patch), F.lit(1e-3))
    return (
        patches.select(*keys, "y", "x", F.posexplode(px).alias("k", "v"))
        .select(
            *keys,
            (F.col("y") + r).alias("y"),
            (F.col("x") + c).alias("x"),
            weight.alias("w"),
            F.col("v").cast("double").alias("v"),
        )
        .groupBy(*keys, "y", "x")
        .agg((F.sum(F.col("v") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-8))).alias("v"))
    )


def select_patches(
    chips: DataFrame, keys: Sequence[str], mask: str, *, patch: int = 256, overlap: int = 64, min_positive: int = 20
) -> DataFrame:
    """Corners of patches holding at least ``min_positive`` mask pixels."""
    return (
        extract_patches(chips, keys, patch, overlap, px=mask)
        .withColumn("positives", F.size(F.filter("px", lambda v: v)))
        .filter(F.col("positives") >= min_positive)
        .select(*keys, "y", "x", "positives")
    )


# ---------------------------------------------------------------- pixel masks


def draw_segments(segments: DataFrame, keys: Sequence[str], *, repeats: bool = False) -> DataFrame:
    """Pixels of straight lines between rounded vertices, clipped to the canvas.

    ``segments``: x0, y0, x1, y1 (doubles) and the canvas height and width.
    Vertices are rounded half to even. Along the longer axis every step is one
    pixel; the shorter offset is the integer form of Bresenham's error rule. Steps
    off the canvas along that axis are never made, so a far vertex costs nothing.
    ``repeats`` leaves shared pixels in, for a caller that merges them anyway.
    """
    ints = segments.select(
        *keys,
        "height",
        "width",
        *[F.rint(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")],
    )
    dx, dy = F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))
    steep = dy > dx
    major, minor = F.greatest(dx, dy), F.least(dx, dy)
    t = F.col("t")
    small = F.when(
        F.col("major") > 0,
        F.floor((2 * t * F.col("minor") + F.col("major")) / F.greatest(2 * F.col("major"), F.lit(1))),
    ).otherwise(F.lit(0)).cast("long")
    sx, sy = F.when(F.col("x1") >= F.col("x0"), 1).otherwise(-1), F.when(F.col("y1") >= F.col("y0"), 1).otherwise(-1)
    # The steps whose place on the longer axis lies on the canvas.
    start = F.when(F.col("steep"), F.col("y0")).otherwise(F.col("x0"))
    last = F.when(F.col("steep"), F.col("height")).otherwise(F.col("width")).cast("long") - 1
    ahead = F.when(F.col("steep"), sy).otherwise(sx) > 0
    low = F.greatest(F.lit(0).cast("long"), F.when(ahead, -start).otherwise(start - last))
    high = F.least(F.col("major"), F.when(ahead, last - start).otherwise(start))
    pixels = (
        ints.withColumn("steep", steep)
        .withColumn("major", major)
        .withColumn("minor", minor)
        .withColumn("low", low)
        .withColumn("high", high)
        .filter(F.col("low") <= F.col("high"))
        .select("*", F.explode(F.sequence("low", "high")).alias("t"))
        .select(
            *keys,
            "height",
            "width",
            (F.col("y0") + sy * F.when(F.col("steep"), t).otherwise(small)).cast("int").alias("y"),
            (F.col("x0") + sx * F.when(F.col("steep"), small).otherwise(t)).cast("int").alias("x"),
        )
        .filter((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") >= 0) & (F.col("x") < F.col("width")))
    )
    return pixels if repeats else pixels.distinct()


def disk_offsets(radius: int) -> list[tuple[int, int]]:
    return [
        (dy, dx)
        for dy in range(-radius, radius + 1)
        for dx in range(-radius, radius + 1)
        if dy * dy + dx * dx <= radius * radius
    ]


def dilate(pixels: DataFrame, keys: Sequence[str], radius: int) -> DataFrame:
    """Grow a pixel mask by a disk; needs canvas ``height`` and ``width`` on each row."""
    if radius <= 0:
        return pixels
    grow = F.array(
        *[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk_offsets(radius)]
    )
    return (
        pixels.select(*keys, "height", "width", "y", "x", F.explode(grow).alias("o"))
        .select(
            *keys,
            "height",
            "width",
            (F.col("y") + F.col("o.dy")).alias("y"),
            (F.col("x") + F.col("o.dx")).alias("x"),
        )
        .filter((F.col("y") >= 0) & (F.col("y") < F.col("height")) & (F.col("x") >= 0) & (F.col("x") < F.col("width")))
        .distinct()
    )


def rasterize(segments: DataFrame, keys: Sequence[str], *, width_px: int = 3) -> DataFrame:
    """Curve segments to mask pixels of the given line width (1: no growth)."""
    lines = draw_segments(segments, keys, repeats=width_px > 1)  # growing merges repeats
    return dilate(lines, keys, width_px // 2) if width_px > 1 else lines
