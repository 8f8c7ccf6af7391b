"""Curve operators on the long form: one row per vertex.

Vertices carry the curve's key columns, an order (one or more columns) and a
``block``: any integer that never decreases along the curve. Every window below
is partitioned by (key, block), so a curve that holds a large share of all
vertices is spread over many tasks. What a block must know about its neighbours
is one row per block (``block_edges``), exchanged on the key alone.

If each curve has one block, the second exchange carries one row per curve.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.functions.expr import finite, unit, wrap_angle
from strandflow.session import spread

BLOCK_ROWS = 65536

# Samples of curves that one task makes or smooths, where their number is known.
SAMPLES_A_TASK = 1_200_000


@dataclass(frozen=True)
class Layout:
    """Which columns identify a curve and order its vertices."""

    keys: Sequence[str] = ("image_id", "filament_id")
    order: Sequence[str] = ("seq",)
    block: str = "block"
    x: str = "x"
    y: str = "y"
    extra: Sequence[str] = field(default=())

    @property
    def by_block(self) -> list[str]:
        return [*self.keys, self.block]

    def window(self) -> Window:
        return Window.partitionBy(*self.by_block).orderBy(*self.order)

    def blocks_window(self) -> Window:
        return Window.partitionBy(*self.keys).orderBy(self.block)


def block_of(seq: Column, rows: int = BLOCK_ROWS) -> Column:
    """The block of a dense vertex number (``rows`` is a power of two)."""
    return F.shiftright(seq.cast("long"), rows.bit_length() - 1)


def explode_points(curves: DataFrame, keys: Sequence[str], points: str = "points") -> DataFrame:
    """Array form (one row per curve) to long form with a dense ``seq``."""
    return curves.select(*keys, F.posexplode(points).alias("seq", "p")).select(
        *keys,
        F.col("seq").cast("long").alias("seq"),
        F.col("p.x").alias("x"),
        F.col("p.y").alias("y"),
        block_of(F.col("seq")).alias("block"),
    )


def _turn(a: Column, b: Column) -> Column:
    """Absolute turning from segment ``a`` to segment ``b`` (structs theta, len)."""
    return F.abs(wrap_angle(b["theta"] - a["theta"]))


def _segment(dx: Column, dy: Column) -> Column:
    """Segment struct, NULL for a repeated vertex (it adds no segment)."""
    return F.when(
        (dx != 0) | (dy != 0),
        F.struct(F.atan2(dy, dx).alias("theta"), F.sqrt(dx * dx + dy * dy).alias("len")),
    )


def _curvature(turn: Column, a: Column, b: Column) -> Column:
    return finite(F.try_divide(turn, (a["len"] + b["len"]) / 2))


def curve_metrics(
    vertices: DataFrame,
    layout: Layout = Layout(),
    *,
    pixel_size: Column | float = 1.0,
    carry: Sequence[str] = (),
) -> DataFrame:
    """The seven shape descriptors plus ``n_points`` for every curve.

    Consecutive equal vertices are skipped; curves with fewer than two distinct
    vertices yield no row; a closed curve has infinite tortuosity; a curve with
    one segment has zero turning. ``carry`` names columns constant per curve.
    """
    scale = pixel_size if isinstance(pixel_size, Column) else F.lit(float(pixel_size))
    w, before = layout.window(), layout.window().rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        vertices.select(
            *layout.by_block,
            *layout.order,
            *carry,
            (F.col(layout.x) * scale).alias("x"),
            (F.col(layout.y) * scale).alias("y"),
        )
        .withColumn("nx", F.lead("x").over(w))
        .withColumn("ny", F.lead("y").over(w))
        .withColumn("is_first", F.lag("x").over(w).isNull())
        .withColumn("seg", _segment(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))
        .withColumn("prev", F.last("seg", ignorenulls=True).over(before))
        .withColumn("turn", _turn(F.col("prev"), F.col("seg")))
        .withColumn("curv", _curvature(F.col("turn"), F.col("prev"), F.col("seg")))
    )
    opens, closes = F.col("is_first"), F.col("nx").isNull()
    lead_seg = F.col("prev").isNull() & F.col("seg").isNotNull()
    blocks = rows.groupBy(*layout.by_block).agg(
        *[F.max(F.when(opens, F.col(c))).alias(c) for c in carry],
        F.max(F.when(opens, F.col("x"))).alias("x0"),
        F.max(F.when(opens, F.col("y"))).alias("y0"),
        F.max(F.when(closes, F.col("x"))).alias("x1"),
        F.max(F.when(closes, F.col("y"))).alias("y1"),
        F.max(F.when(lead_seg, F.col("seg.theta"))).alias("theta0"),
        F.max(F.when(lead_seg, F.col("seg.len"))).alias("len0"),
        F.max(F.when(closes, F.col("prev.theta"))).alias("theta1"),
        F.max(F.when(closes, F.col("prev.len"))).alias("len1"),
        F.sum("seg.len").alias("len"),
        F.count("seg").alias("n_seg"),
        F.sum("turn").alias("turn"),
        F.max("curv").alias("max_curv"),
        F.sum("curv").alias("sum_curv"),
        F.count("curv").alias("n_curv"),
    )
    wb = layout.blocks_window()
    wb_before = wb.rowsBetween(Window.unboundedPreceding, -1)

    def seg_of(theta: str, length: str) -> Column:
        return F.when(
            F.col(theta).isNotNull(),
            F.struct(F.col(theta).alias("theta"), F.col(length).alias("len")),
        )

    joined = (
        blocks.withColumn("px", F.lag("x1").over(wb))
        .withColumn("py", F.lag("y1").over(wb))
        .withColumn("is_last", F.lead("x0").over(wb).isNull())
        .withColumn("first_seg", seg_of("theta0", "len0"))
        .withColumn("last_seg", seg_of("theta1", "len1"))
        .withColumn("gap_seg", _segment(F.col("x0") - F.col("px"), F.col("y0") - F.col("py")))
        .withColumn(
            "seen", F.last(F.coalesce("last_seg", "gap_seg"), ignorenulls=True).over(wb_before)
        )
        .withColumn("reach", F.coalesce("gap_seg", "seen"))
        .withColumn("turn_a", _turn(F.col("seen"), F.col("gap_seg")))
        .withColumn("turn_b", F.when(F.col("px").isNotNull(), _turn(F.col("reach"), F.col("first_seg"))))
        .withColumn("curv_a", _curvature(F.col("turn_a"), F.col("seen"), F.col("gap_seg")))
        .withColumn("curv_b", _curvature(F.col("turn_b"), F.col("reach"), F.col("first_seg")))
    )
    zero = F.lit(0.0)

    def total(*cols: str) -> Column:
        parts = [F.coalesce(F.sum(c), zero) for c in cols]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    head, tail = F.col("px").isNull(), F.col("is_last")
    sums = joined.groupBy(*layout.keys).agg(
        *[F.max(c).alias(c) for c in carry],
        total("len", "gap_seg.len").alias("length"),
        (F.sum("n_seg") + F.count("gap_seg")).alias("n_seg"),
        total("turn", "turn_a", "turn_b").alias("turn"),
        F.greatest(F.max("max_curv"), F.max("curv_a"), F.max("curv_b")).alias("max_curv"),
        total("sum_curv", "curv_a", "curv_b").alias("sum_curv"),
        (F.sum("n_curv") + F.count("curv_a") + F.count("curv_b")).alias("n_curv"),
        F.max(F.when(head, F.col("x0"))).alias("xa"),
        F.max(F.when(head, F.col("y0"))).alias("ya"),
        F.max(F.when(tail, F.col("x1"))).alias("xb"),
        F.max(F.when(tail, F.col("y1"))).alias("yb"),
    )
    dx, dy = F.col("xb") - F.col("xa"), F.col("yb") - F.col("ya")
    chord = F.sqrt(dx * dx + dy * dy)
    mean_curv = F.coalesce(F.try_divide(F.col("sum_curv"), F.col("n_curv")), zero)
    return sums.filter("n_seg >= 1").select(
        *layout.keys,
        *carry,
        F.col("length"),
        F.when(chord > 0, F.col("length") / chord)
        .otherwise(F.lit(float("inf")))
        .alias("tortuosity"),
        F.coalesce(F.col("max_curv"), zero).alias("max_curvature"),
        mean_curv.alias("mean_abs_curvature"),
        F.col("turn").alias("total_abs_turning"),
        F.coalesce(F.try_divide(F.col("turn"), F.col("length")), zero).alias(
            "total_abs_turning_per_length"
        ),
        mean_curv.alias("local_dir_change_per_length"),
        (F.col("n_seg") + 1).cast("int").alias("n_points"),
    )


def with_position(
    vertices: DataFrame, layout: Layout = Layout(), *, carry: Sequence[str] = ()
) -> DataFrame:
    """Each vertex with its dense index ``i``, count ``n``, arc length ``s``, the
    curve's ``total`` length, and its neighbours' coordinates and arc length.

    ``s_next`` equals the next vertex's own ``s`` bit for bit, so intervals
    [s, s_next) tile [0, total) exactly.
    """
    w = layout.window()
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    # Stated here, so that the filters the join below infers are the same on
    # both of its sides and the exchange of the vertices is used twice.
    known = " AND ".join(f"`{c}` IS NOT NULL" for c in layout.by_block)
    rows = (
        vertices.filter(known)
        .select(
            *layout.by_block,
            *layout.order,
            *carry,
            F.col(layout.x).alias("x"),
            F.col(layout.y).alias("y"),
        )
        .withColumn("rn", F.row_number().over(w).cast("long") - 1)
        .withColumn("lx", F.lag("x").over(w))
        .withColumn("ly", F.lag("y").over(w))
        .withColumn("nx", F.lead("x").over(w))
        .withColumn("ny", F.lead("y").over(w))
        .withColumn(
            "step",
            F.sqrt(
                (F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x"))
                + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y"))
            ),
        )
        .withColumn("r", F.coalesce(F.sum("step").over(running), F.lit(0.0)))
        .withColumn("r_next", F.lead("r").over(w))
    )
    closes = F.col("nx").isNull()
    edges = rows.groupBy(*layout.by_block).agg(
        F.count(F.lit(1)).alias("b_n"),
        F.max("r").alias("b_len"),
        F.max(F.when(F.col("rn") == 0, F.col("x"))).alias("b_x0"),
        F.max(F.when(F.col("rn") == 0, F.col("y"))).alias("b_y0"),
        F.max(F.when(closes, F.col("x"))).alias("b_x1"),
        F.max(F.when(closes, F.col("y"))).alias("b_y1"),
    )
    wb = layout.blocks_window()
    whole = wb.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prior = wb.rowsBetween(Window.unboundedPreceding, -1)
    upto = wb.rowsBetween(Window.unboundedPreceding, 0)
    edges = (
        edges.withColumn("p_x", F.lag("b_x1").over(wb))
        .withColumn("p_y", F.lag("b_y1").over(wb))
        .withColumn("q_x", F.lead("b_x0").over(wb))
        .withColumn("q_y", F.lead("b_y0").over(wb))
        .withColumn("i0", F.coalesce(F.sum("b_n").over(prior), F.lit(0)))
        .withColumn("n", F.sum("b_n").over(whole))
        .withColumn(
            "gap",
            F.coalesce(
                F.sqrt(
                    (F.col("b_x0") - F.col("p_x")) * (F.col("b_x0") - F.col("p_x"))
                    + (F.col("b_y0") - F.col("p_y")) * (F.col("b_y0") - F.col("p_y"))
                ),
                F.lit(0.0),
            ),
        )
        .withColumn("walked", F.col("gap") + F.col("b_len"))
        .withColumn("s0", F.coalesce(F.sum("walked").over(prior), F.lit(0.0)) + F.col("gap"))
        .withColumn("s_after", F.lead("s0").over(wb))
        .withColumn("total", F.last(F.col("s0") + F.col("b_len")).over(whole))
        .select(*layout.by_block, "p_x", "p_y", "q_x", "q_y", "i0", "n", "s0", "s_after", "total")
    )
    # The vertices are already sorted by block: a merge join adds no sort to them,
    # and they are never broadcast, however small they look.
    return rows.join(edges.hint("merge"), layout.by_block).select(
        *layout.by_block,
        *carry,
        (F.col("i0") + F.col("rn")).alias("i"),
        "n",
        "x",
        "y",
        (F.col("s0") + F.col("r")).alias("s"),
        F.coalesce(F.col("s0") + F.col("r_next"), F.col("s_after")).alias("s_next"),
        "total",
        F.coalesce("lx", F.when(F.col("rn") == 0, F.col("p_x"))).alias("x_prev"),
        F.coalesce("ly", F.when(F.col("rn") == 0, F.col("p_y"))).alias("y_prev"),
        F.coalesce("nx", "q_x").alias("x_next"),
        F.coalesce("ny", "q_y").alias("y_next"),
    )


def drop_repeats(vertices: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Vertices that differ from the one before them (the first is always kept)."""
    pos = with_position(vertices, layout)
    return pos.filter(
        F.col("x_prev").isNull()
        | (F.col("x") != F.col("x_prev"))
        | (F.col("y") != F.col("y_prev"))
    ).select(*layout.by_block, "i", "x", "y")


def resample(
    vertices: DataFrame,
    layout: Layout = Layout(),
    *,
    step: float = 1.0,
    carry: Sequence[str] = (),
    rows: int = 0,
) -> DataFrame:
    """Uniform arc-length spacing near ``step``; columns ``seq, n, x, y, block``.

    Each vertex emits the sample numbers that fall on the segment it opens, so
    no range join is needed. The last sample is the last vertex itself. A curve
    of one vertex is returned as it is; one of zero length gives its first vertex.
    ``rows``: the number of samples, where it is known.
    """
    # Rows multiply below this exchange, so its partitions must not be merged by size.
    pos = with_position(spread(vertices, *layout.by_block, rows=rows, each=SAMPLES_A_TASK), layout, carry=carry)
    count = F.greatest(F.ceil(F.col("total") / F.lit(float(step))) + 1, F.lit(2)).cast("long")
    pos = pos.withColumn("m", F.when(F.col("total") > 0, count).otherwise(F.lit(1).cast("long")))
    h = F.col("total") / (F.col("m") - 1)
    length = F.col("s_next") - F.col("s")
    inner = (F.col("total") > 0) & F.col("s_next").isNotNull() & (length > 0)
    picks = (
        F.when(
            inner,
            F.sequence(
                F.greatest(F.floor(F.col("s") / h).cast("long") - 1, F.lit(0).cast("long")),
                F.floor(F.col("s_next") / h).cast("long") + 1,
            ),
        )
        .when((F.col("total") > 0) & F.col("s_next").isNull(), F.array(F.col("m") - 1))
        .when((F.col("total") <= 0) & (F.col("i") == 0), F.array(F.lit(0).cast("long")))
        .otherwise(F.array().cast("array<bigint>"))
    )
    at = F.col("seq") * h
    part = (at - F.col("s")) / length
    on_segment = (at >= F.col("s")) & (at < F.col("s_next")) & (F.col("seq") < F.col("m") - 1)
    return (
        pos.select("*", F.explode(picks).alias("seq"))
        .filter(F.when(inner, on_segment).otherwise(F.lit(True)))
        .select(
            *layout.keys,
            *carry,
            "seq",
            F.col("m").alias("n"),
            F.when(inner, F.col("x") + part * (F.col("x_next") - F.col("x")))
            .otherwise(F.col("x"))
            .alias("x"),
            F.when(inner, F.col("y") + part * (F.col("y_next") - F.col("y")))
            .otherwise(F.col("y"))
            .alias("y"),
            block_of(F.col("seq")).alias("block"),
        )
    )


def smooth(
    vertices: DataFrame,
    keys: Sequence[str] = ("image_id", "filament_id"),
    *,
    window: int = 5,
    carry: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
    rows: int = 0,
) -> DataFrame:
    """Moving average with replicated edges; both end vertices stay fixed.

    Needs a dense ``seq`` from 0 and the vertex count ``n``. Vertices near a
    block border are also sent to the neighbouring block, so one exchange is
    enough and no block waits for another.
    """
    if window < 3:
        return vertices
    width = window + 1 if window % 2 == 0 else window
    pad = width // 2
    if block_rows <= pad:
        raise ValueError("block_rows must exceed half the window")
    seq, last = F.col("seq"), F.col("n") - 1

    def copy(block: Column, at: Column) -> Column:
        return F.struct(block.alias("block"), at.alias("at"))

    home = block_of(seq, block_rows)
    lower, upper = block_of(seq - pad, block_rows), block_of(seq + pad, block_rows)

    def repeats(first: Column, end: Column) -> Column:
        """The vertex again at the places past the curve's end."""
        places = F.sequence(first, end)
        blocks = F.when((lower == home) | (seq < pad), F.array(home)).otherwise(F.array(lower, home))
        return F.flatten(F.transform(blocks, lambda b: F.transform(places, lambda k: copy(b, k))))

    own = F.array(copy(home, seq))
    copies = (
        F.when((seq >= pad) & (seq <= last - pad) & (lower == home) & (upper == home), own)
        .otherwise(
            F.concat(
                own,
                F.when((lower != home) & (seq >= pad), F.array(copy(lower, seq))).otherwise(F.array()),
                F.when((upper != home) & (seq <= last - pad), F.array(copy(upper, seq))).otherwise(F.array()),
                F.when(seq == 0, repeats(seq - pad, seq - 1)).otherwise(F.array()),
                F.when(seq == last, repeats(seq + 1, seq + pad)).otherwise(F.array()),
            )
        )
    )
    w = Window.partitionBy(*keys, "block").orderBy("at").rowsBetween(-pad, pad)
    sent = vertices.select(*keys, *carry, "seq", "n", "x", "y", F.explode(copies).alias("c")).select(
        *keys, *carry, "seq", "n", "x", "y", "c.block", "c.at"
    )
    if rows:
        sent = spread(sent, *keys, "block", rows=rows, each=SAMPLES_A_TASK)
    fixed = (F.col("n") <= window) | (seq == 0) | (seq == last)

    def mean(c: str) -> Column:
        return F.when(fixed, F.col(c)).otherwise(F.sum(c).over(w) / F.lit(float(width)))

    return (
        sent.select("*", mean("x").alias("sx"), mean("y").alias("sy"))
        .filter((F.col("at") == seq) & (F.col("block") == home))
        .select(*keys, *carry, "seq", "n", F.col("sx").alias("x"), F.col("sy").alias("y"), "block")
    )


def finish(
    vertices: DataFrame,
    layout: Layout = Layout(),
    *,
    step: float = 1.0,
    window: int = 5,
    carry: Sequence[str] = (),
    rows: int = 0,
) -> DataFrame:
    """Resample, then smooth. Apply once per curve: a second pass halves curvature.

    ``rows``: the number of samples, where it is known (see ``count_samples``).
    """
    return smooth(
        resample(vertices, layout, step=step, carry=carry, rows=rows), layout.keys, window=window, carry=carry, rows=rows
    )


def count_samples(vertices: DataFrame, layout: Layout = Layout(), *, step: float = 1.0) -> int:
    """About how many samples ``resample`` makes: one job over the vertices, which may be far fewer."""
    length = curve_metrics(vertices, layout).filter("isnotnull(length) and not isnan(length)")
    return int(length.agg(F.sum(F.ceil(F.col("length") / F.lit(float(step))) + 1)).first()[0] or 0)


def unit_normals(vertices: DataFrame, layout: Layout = Layout(), *, carry: Sequence[str] = ()) -> DataFrame:
    """Unit normals from central differences (one sided at the ends)."""
    pos = with_position(vertices, layout, carry=carry)
    spread = F.when(F.col("x_prev").isNull() | F.col("x_next").isNull(), F.lit(1.0)).otherwise(2.0)
    tx = (F.coalesce("x_next", "x") - F.coalesce("x_prev", "x")) / spread
    ty = (F.coalesce("y_next", "y") - F.coalesce("y_prev", "y")) / spread
    ux, uy = unit(tx, ty)
    return pos.select(*layout.by_block, *carry, "i", "n", "x", "y", (-uy).alias("nx"), ux.alias("ny"))


def endpoints(vertices: DataFrame, layout: Layout = Layout(), *, span: int = 8) -> DataFrame:
    """Two rows per curve: end position and unit direction pointing out of it."""
    pos = with_position(vertices, layout)
    reach = F.least(F.lit(span).cast("long"), F.col("n") - 1)

    def at(index: Column, name: str) -> list[Column]:
        hit = F.col("i") == index
        return [
            F.max(F.when(hit, F.col("x"))).alias(f"{name}_x"),
            F.max(F.when(hit, F.col("y"))).alias(f"{name}_y"),
        ]

    ends = (
        pos.filter((F.col("i") <= span) | (F.col("i") >= F.col("n") - 1 - span))
        .groupBy(*layout.keys)
        .agg(
            *at(F.lit(0), "a"),
            *at(reach, "a2"),
            *at(F.col("n") - 1, "b"),
            *at(F.col("n") - 1 - reach, "b2"),
        )
    )

    return facing_out(ends, list(layout.keys))


def facing_out(ends: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both ends of each curve as rows, from its ends ``a``, ``b`` and the vertices ``a2``, ``b2`` further in."""

    def end(flag: bool, p: str) -> Column:
        dx, dy = unit(F.col(f"{p}_x") - F.col(f"{p}2_x"), F.col(f"{p}_y") - F.col(f"{p}2_y"))
        return F.struct(
            F.lit(flag).alias("at_start"),
            F.col(f"{p}_x").alias("x"),
            F.col(f"{p}_y").alias("y"),
            dx.alias("dx"),
            dy.alias("dy"),
        )

    return ends.select(*keys, F.explode(F.array(end(True, "a"), end(False, "b"))).alias("e")).select(*keys, "e.*")


# Fixed value: samples per cubic segment.
BEZIER_SAMPLES = 24


def flatten_bezier(p0: Column, p1: Column, p2: Column, p3: Column, samples: int = BEZIER_SAMPLES) -> Column:
    """Array of points along a cubic, from four point structs."""

    def at(k: Column) -> Column:
        t = k / F.lit(float(samples - 1))
        u = F.lit(1.0) - t
        weights = (u * u * u, u * u * t * 3, u * t * t * 3, t * t * t)

        def coord(c: str) -> Column:
            terms = [w * p[c] for w, p in zip(weights, (p0, p1, p2, p3), strict=True)]
            return terms[0] + terms[1] + terms[2] + terms[3]

        return F.struct(coord("x").alias("x"), coord("y").alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), at)
