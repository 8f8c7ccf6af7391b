"""Named queries over the stand-in views, and the same questions in SQL.

Floats are rounded on both sides: two engines add in different orders, so the
last bits of a sum may differ.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandflow import session
from strandflow.config import TraceConfig
from strandflow.functions.expr import ratio
from strandflow.operators import (
    accuracy,
    curves,
    graph,
    junctions,
    matching,
    micrographs,
    patches,
    proximity,
    quantiles,
    rasters,
    ridge,
    snap,
    splits,
    stats,
    tiles,
    tracer,
)
from strandflow.plans import jobs
from strandflow.plans import standins as S
from strandflow.schema import METRICS
from strandflow.session import spread, whole
from strandflow.sources.traces import number_curves

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded; negative zero becomes zero."""
    return df.select(
        *[
            (F.round(F.col(f.name), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


# ---------------------------------------------------------------- SQL parts

V1_SQL = """v1 AS (
  SELECT user_id AS filament_id, user_id % 30 AS image_id, (user_id % 30) % 5 AS patient_id,
         epoch_us(ts) - 1704067200000000 AS ord,
         CAST(epoch_us(ts) - 1704067200000000 AS DOUBLE) / 3600000000::DOUBLE AS x, value AS y
  FROM events)"""

V2_SQL = """v2 AS (
  SELECT l_orderkey AS filament_id, o_custkey AS image_id, c_nationkey AS patient_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
                            l_shipdate, l_quantity, l_extendedprice) AS ord,
         {x} AS x, {y} AS y
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)"""

V3_SQL = """v3 AS (
  SELECT vec_id AS filament_id, label AS patient_id, k AS ord,
         CAST(embedding[2 * k + 1] AS DOUBLE) AS x, CAST(embedding[2 * k + 2] AS DOUBLE) AS y
  FROM embeddings, range(0, 32) AS r(k))"""

FIELD_SQL = V3_SQL + """, field AS (
  SELECT patient_id AS image_id, filament_id, ord,
         x + 0.4::DOUBLE * ((filament_id // 2) % 8) AS x,
         y + 0.4::DOUBLE * ((filament_id // 2) // 8) AS y
  FROM v3)"""

V4_SQL = """v4 AS (
  SELECT vec_id, label, k AS k, k // 8 AS y, k % 8 AS x, CAST(embedding[k + 1] AS DOUBLE) AS v
  FROM embeddings, range(0, 64) AS r(k))"""


def r6(expr: str, name: str, digits: int = 6) -> str:
    return f"round({expr}, {digits}) + 0.0::DOUBLE AS {name}"


def metrics_sql(src: str, keys: str, *, carry: str = "", scale: str = "1.0::DOUBLE") -> str:
    """CTE chain from vertices ``src(keys, ord, x, y)`` to ``metrics``."""
    extra = f"any_value({carry}) AS {carry}," if carry else ""
    return f"""
  m_raw AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py
            FROM (SELECT * REPLACE (x * {scale} AS x, y * {scale} AS y) FROM {src})
            WINDOW w AS (PARTITION BY {keys} ORDER BY ord)),
  m_kept AS (SELECT * FROM m_raw WHERE px IS NULL OR x <> px OR y <> py),
  m_seg AS (SELECT *, lead(x) OVER w - x AS dx, lead(y) OVER w - y AS dy
            FROM m_kept WINDOW w AS (PARTITION BY {keys} ORDER BY ord)),
  m_dir AS (SELECT *, atan2(dy, dx) AS th, sqrt(dx * dx + dy * dy) AS ds FROM m_seg),
  m_next AS (SELECT *, lead(th) OVER w - th AS raw_turn, (ds + lead(ds) OVER w) / 2 AS s
             FROM m_dir WINDOW w AS (PARTITION BY {keys} ORDER BY ord)),
  m_turn AS (SELECT *, abs(raw_turn + pi() - 2 * pi() * floor((raw_turn + pi()) / (2 * pi())) - pi()) AS turn
             FROM m_next),
  m_sum AS (SELECT {keys}, {extra} sum(ds) AS len, sum(turn) AS tt, max(turn / s) AS mx, avg(turn / s) AS av,
                   sqrt(power(arg_max(x, ord) - arg_min(x, ord), 2) + power(arg_max(y, ord) - arg_min(y, ord), 2)) AS chord,
                   count(*) AS n
            FROM m_turn GROUP BY {keys} HAVING count(*) >= 2),
  metrics AS (SELECT {keys}, {carry + "," if carry else ""}
                     len AS length,
                     CASE WHEN chord > 0 THEN len / chord ELSE 'inf'::DOUBLE END AS tortuosity,
                     coalesce(mx, 0) AS max_curvature, coalesce(av, 0) AS mean_abs_curvature,
                     coalesce(tt, 0) AS total_abs_turning, coalesce(tt / len, 0) AS total_abs_turning_per_length,
                     coalesce(av, 0) AS local_dir_change_per_length, CAST(n AS INTEGER) AS n_points
              FROM m_sum)"""


METRIC_COLS = ", ".join(
    f"CASE WHEN isfinite({m}) THEN round({m}, 6) + 0.0::DOUBLE ELSE {m} END AS {m}" for m in METRICS
)


def metrics_query_sql(view: str, src: str, keys: str, carry: str = "") -> str:
    cols = f"{keys}, {carry + ',' if carry else ''} {METRIC_COLS}, n_points"
    return f"WITH {view}, {metrics_sql(src, keys, carry=carry)} SELECT {cols} FROM metrics"


def arc_sql(src: str, keys: str) -> str:
    """CTE chain to ``arc``: i, n, s, s_next, total and neighbours."""
    return f"""
  a_step AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY {keys}) AS n,
                    lead(x) OVER w AS xn, lead(y) OVER w AS yn, lag(x) OVER w AS xp, lag(y) OVER w AS yp
             FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY ord)),
  a_len AS (SELECT *, sqrt(power(xn - x, 2) + power(yn - y, 2)) AS ds FROM a_step),
  a_sum AS (SELECT *, coalesce(sum(ds) OVER (PARTITION BY {keys} ORDER BY ord
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM a_len),
  arc AS (SELECT *, lead(s) OVER (PARTITION BY {keys} ORDER BY ord) AS s_next,
                 max(s) OVER (PARTITION BY {keys}) AS total FROM a_sum)"""


def resample_sql(src: str, keys: str, step: str = "1.0") -> str:
    return arc_sql(src, keys) + f""",
  rs_m AS (SELECT *, CAST(greatest(ceil(total / {step}::DOUBLE) + 1, 2) AS BIGINT) AS m FROM arc WHERE total > 0),
  rs_k AS (SELECT *, unnest(CASE WHEN s_next IS NULL THEN [m - 1]
                            ELSE range(CAST(greatest(floor(s / (total / (m - 1))) - 1, 0) AS BIGINT),
                                       CAST(floor(s_next / (total / (m - 1))) AS BIGINT) + 2) END) AS k
           FROM rs_m WHERE s_next IS NULL OR s_next > s),
  resampled AS (SELECT {keys}, k AS ord, m AS n,
                  CASE WHEN s_next IS NULL THEN x ELSE x + (k * (total / (m - 1)) - s) / (s_next - s) * (xn - x) END AS x,
                  CASE WHEN s_next IS NULL THEN y ELSE y + (k * (total / (m - 1)) - s) / (s_next - s) * (yn - y) END AS y
                FROM rs_k
                WHERE s_next IS NULL OR (k * (total / (m - 1)) >= s AND k * (total / (m - 1)) < s_next AND k < m - 1))"""


def smooth_sql(src: str, keys: str, window: int = 5) -> str:
    pad = window // 2
    frame = f"OVER (PARTITION BY {keys} ORDER BY ord ROWS BETWEEN {pad} PRECEDING AND {pad} FOLLOWING)"
    edge = f"OVER (PARTITION BY {keys} ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"

    def mean(c: str) -> str:
        return f"""CASE WHEN n <= {window} OR ord = 0 OR ord = n - 1 THEN {c} ELSE
          (sum({c}) {frame} + greatest({pad} - ord, 0) * first_value({c}) {edge}
           + greatest({pad} - (n - 1 - ord), 0) * last_value({c}) {edge}) / {window}.0::DOUBLE END"""

    return f"smoothed AS (SELECT {keys}, ord, n, {mean('x')} AS x, {mean('y')} AS y FROM {src})"


# Two-sided 95% Student factor by bisection on the finite trigonometric series
# for integer degrees of freedom; independent of the incomplete beta used in Spark.
T_SQL = """
  t_iter AS (
    SELECT df, 0::DOUBLE AS lo, 50000::DOUBLE AS hi, 0 AS step FROM t_df
    UNION ALL
    SELECT df, CASE WHEN p < 0.95 THEN mid ELSE lo END, CASE WHEN p < 0.95 THEN hi ELSE mid END, step + 1
    FROM (SELECT df, lo, hi, step, mid,
            CASE WHEN df % 2 = 1
              THEN 2 / pi() * (th + sin(th) * cos(th) * coalesce(list_sum([exp(lgamma(k + 1.0::DOUBLE) + lgamma(1.5::DOUBLE) - lgamma(k + 1.5::DOUBLE))
                     * power(cos(th), 2 * k) for k in range(0, (df - 1) // 2)]), 0))
              ELSE sin(th) * list_sum([exp(lgamma(k + 0.5::DOUBLE) - lgamma(0.5::DOUBLE) - lgamma(k + 1.0::DOUBLE))
                     * power(cos(th), 2 * k) for k in range(0, df // 2)])
            END AS p
          FROM (SELECT *, (lo + hi) / 2 AS mid, atan((lo + hi) / 2 / sqrt(df)) AS th FROM t_iter WHERE step < 80))),
  t_crit AS (SELECT df, (lo + hi) / 2 AS t FROM t_iter WHERE step = 80)"""


def summary_sql(view: str, src: str, keys: str) -> str:
    return f"""WITH RECURSIVE {view}, {metrics_sql(src, keys, carry="patient_id")},
  long AS (UNPIVOT (SELECT patient_id, {", ".join(METRICS)} FROM metrics)
           ON {", ".join(METRICS)} INTO NAME metric VALUE v),
  agg AS (SELECT patient_id, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd
          FROM long WHERE isfinite(v) GROUP BY ALL),
  t_df AS (SELECT DISTINCT n - 1 AS df FROM agg WHERE n > 1),
  {T_SQL}
  SELECT patient_id, metric, n, {r6("mean", "mean")}, {r6("sd", "sd")},
         {r6("CASE WHEN n = 1 THEN mean ELSE mean - t * sd / sqrt(n) END", "ci95_low")},
         {r6("CASE WHEN n = 1 THEN mean ELSE mean + t * sd / sqrt(n) END", "ci95_high")}
  FROM agg LEFT JOIN t_crit ON df = n - 1"""


# ---------------------------------------------------------------- metrics


@query("curve_metrics_events", metrics_query_sql(V1_SQL, "v1", "image_id, filament_id", "patient_id"))
def curve_metrics_events(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.curve_metrics(S.curves_events(spark, d), S.V1, carry=["patient_id"]))


V2_PLAIN = V2_SQL.format(x="l_quantity", y="l_extendedprice / 1000")
V2_COARSE = V2_SQL.format(x="floor(l_quantity / 10)", y="floor(l_extendedprice / 20000)")


@query("curve_metrics_orders", metrics_query_sql(V2_PLAIN, "v2", "image_id, filament_id", "patient_id"))
def curve_metrics_orders(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.curve_metrics(S.curves_orders(spark, d), S.V2, carry=["patient_id"]))


@query("curve_metrics_repeats", metrics_query_sql(V2_COARSE, "v2", "image_id, filament_id"))
def curve_metrics_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Coarse coordinates: many repeated vertices, closed curves and collapsed curves."""
    v = S.curves_orders(
        spark,
        d,
        x=F.floor(F.col("l_quantity") / 10).cast("double"),
        y=F.floor(F.col("l_extendedprice") / 20000).cast("double"),
    )
    return rounded(curves.curve_metrics(v, S.V2))


@query("curve_metrics_arrays", metrics_query_sql(V3_SQL, "v3", "patient_id, filament_id"))
def curve_metrics_arrays(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.curve_metrics(S.curves_vec(spark, d), S.V3))


@query(
    "pixel_size_scaling",
    f"""WITH {V1_SQL},
    p1 AS (WITH {metrics_sql("v1", "image_id, filament_id")} SELECT * FROM metrics),
    p2 AS (WITH {metrics_sql("v1", "image_id, filament_id", scale="0.3299::DOUBLE")} SELECT * FROM metrics)
    SELECT image_id, filament_id, {r6("p2.length", "length_nm")}, {r6("p2.length / p1.length", "length_ratio")},
           {r6("p2.tortuosity / p1.tortuosity", "tortuosity_ratio")},
           {r6("p2.mean_abs_curvature", "mean_abs_curvature_per_nm")},
           {r6("p2.mean_abs_curvature / p1.mean_abs_curvature", "curvature_ratio")}
    FROM p1 JOIN p2 USING (image_id, filament_id)""",
)
def pixel_size_scaling(spark: SparkSession, d: str) -> DataFrame:
    v = S.curves_events(spark, d)
    px = curves.curve_metrics(v, S.V1).alias("a")
    nm = curves.curve_metrics(v, S.V1, pixel_size=0.3299).alias("b")
    return rounded(
        px.join(nm, ["image_id", "filament_id"]).select(
            "image_id",
            "filament_id",
            F.col("b.length").alias("length_nm"),
            ratio(F.col("b.length"), F.col("a.length")).alias("length_ratio"),
            ratio(F.col("b.tortuosity"), F.col("a.tortuosity")).alias("tortuosity_ratio"),
            F.col("b.mean_abs_curvature").alias("mean_abs_curvature_per_nm"),
            ratio(F.col("b.mean_abs_curvature"), F.col("a.mean_abs_curvature")).alias("curvature_ratio"),
        )
    )


@query(
    "dedup_vertices",
    f"""WITH {V2_COARSE}, p AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py FROM v2
        WINDOW w AS (PARTITION BY image_id, filament_id ORDER BY ord))
    SELECT image_id, filament_id, count(*) AS n_before,
           count(*) FILTER (px IS NULL OR x <> px OR y <> py) AS n_after
    FROM p GROUP BY ALL""",
)
def dedup_vertices(spark: SparkSession, d: str) -> DataFrame:
    v = S.curves_orders(
        spark,
        d,
        x=F.floor(F.col("l_quantity") / 10).cast("double"),
        y=F.floor(F.col("l_extendedprice") / 20000).cast("double"),
    )
    before = v.groupBy("image_id", "filament_id").agg(F.count(F.lit(1)).alias("n_before"))
    after = curves.drop_repeats(v, S.V2).groupBy("image_id", "filament_id").agg(
        F.count(F.lit(1)).alias("n_after")
    )
    return before.join(after, ["image_id", "filament_id"])


# ---------------------------------------------------------------- positions


@query(
    "cumulative_arc",
    f"""WITH {V1_SQL}, {arc_sql("v1", "image_id, filament_id")}
    SELECT image_id, filament_id, i, n, {r6("s", "s")}, {r6("total", "total")} FROM arc""",
)
def cumulative_arc(spark: SparkSession, d: str) -> DataFrame:
    pos = curves.with_position(S.curves_events(spark, d), S.V1)
    return rounded(pos.select("image_id", "filament_id", "i", "n", "s", "total"))


@query(
    "resample",
    f"""WITH {V1_SQL}, {resample_sql("v1", "image_id, filament_id")}
    SELECT image_id, filament_id, ord AS i, n, {r6("x", "x")}, {r6("y", "y")} FROM resampled""",
)
def resample(spark: SparkSession, d: str) -> DataFrame:
    r = curves.resample(S.curves_events(spark, d), S.V1)
    return rounded(r.select("image_id", "filament_id", F.col("seq").alias("i"), "n", "x", "y"))


@query(
    "smooth",
    f"""WITH {V1_SQL}, num AS (SELECT image_id, filament_id, x, y,
          row_number() OVER (PARTITION BY image_id, filament_id ORDER BY ord) - 1 AS ord,
          count(*) OVER (PARTITION BY image_id, filament_id) AS n FROM v1),
    {smooth_sql("num", "image_id, filament_id", 5)}
    SELECT image_id, filament_id, ord AS i, {r6("x", "x")}, {r6("y", "y")} FROM smoothed""",
)
def smooth(spark: SparkSession, d: str) -> DataFrame:
    pos = curves.with_position(S.curves_events(spark, d), S.V1)
    out = curves.smooth(pos.withColumnRenamed("i", "seq"), window=5)
    return rounded(out.select("image_id", "filament_id", F.col("seq").alias("i"), "x", "y"))


@query(
    "finish_then_metrics",
    f"""WITH {V1_SQL}, {resample_sql("v1", "image_id, filament_id")},
    {smooth_sql("resampled", "image_id, filament_id")}, {metrics_sql("smoothed", "image_id, filament_id")}
    SELECT image_id, filament_id, {METRIC_COLS}, n_points FROM metrics""",
)
def finish_then_metrics(spark: SparkSession, d: str) -> DataFrame:
    v = S.curves_events(spark, d)
    # A vertex opens some dozens of samples.
    done = curves.finish(v, S.V1, rows=curves.count_samples(v, S.V1))
    return rounded(curves.curve_metrics(done, curves.Layout()))


@query(
    "unit_normals",
    f"""WITH {V1_SQL}, {arc_sql("v1", "image_id, filament_id")},
    g AS (SELECT *, (coalesce(xn, x) - coalesce(xp, x)) / CASE WHEN xn IS NULL OR xp IS NULL THEN 1 ELSE 2 END AS tx,
                 (coalesce(yn, y) - coalesce(yp, y)) / CASE WHEN xn IS NULL OR xp IS NULL THEN 1 ELSE 2 END AS ty FROM arc)
    SELECT image_id, filament_id, i,
           {r6("CASE WHEN tx <> 0 OR ty <> 0 THEN -ty / sqrt(tx * tx + ty * ty) ELSE 0 END", "nx")},
           {r6("CASE WHEN tx <> 0 OR ty <> 0 THEN tx / sqrt(tx * tx + ty * ty) ELSE 0 END", "ny")} FROM g""",
)
def unit_normals(spark: SparkSession, d: str) -> DataFrame:
    n = curves.unit_normals(S.curves_events(spark, d), S.V1)
    return rounded(n.select("image_id", "filament_id", "i", "nx", "ny"))


ENDS_SQL = """
  e_pts AS (SELECT *, least(8, n - 1) AS span FROM arc),
  e_sum AS (SELECT image_id, filament_id,
      max(x) FILTER (i = 0) AS x0, max(y) FILTER (i = 0) AS y0,
      max(x) FILTER (i = span) AS x1, max(y) FILTER (i = span) AS y1,
      max(x) FILTER (i = n - 1) AS x3, max(y) FILTER (i = n - 1) AS y3,
      max(x) FILTER (i = n - 1 - span) AS x2, max(y) FILTER (i = n - 1 - span) AS y2
    FROM e_pts GROUP BY ALL),
  e_raw AS (SELECT image_id, filament_id, true AS at_start, x0 AS x, y0 AS y, x0 - x1 AS vx, y0 - y1 AS vy FROM e_sum
            UNION ALL SELECT image_id, filament_id, false, x3, y3, x3 - x2, y3 - y2 FROM e_sum),
  ends AS (SELECT image_id, filament_id, at_start, x, y,
             CASE WHEN vx <> 0 OR vy <> 0 THEN vx / sqrt(vx * vx + vy * vy) ELSE 0 END AS dx,
             CASE WHEN vx <> 0 OR vy <> 0 THEN vy / sqrt(vx * vx + vy * vy) ELSE 0 END AS dy FROM e_raw)"""


@query(
    "endpoints",
    f"""WITH {V1_SQL}, {arc_sql("v1", "image_id, filament_id")}, {ENDS_SQL}
    SELECT image_id, filament_id, at_start, {r6("x", "x")}, {r6("y", "y")}, {r6("dx", "dx")}, {r6("dy", "dy")} FROM ends""",
)
def endpoints(spark: SparkSession, d: str) -> DataFrame:
    return rounded(curves.endpoints(S.curves_events(spark, d), S.V1))


@query(
    "bezier_flatten",
    f"""WITH {V3_SQL},
    m AS (SELECT filament_id, ord // 3 AS cubic, ord % 3 AS c, x, y FROM v3
          UNION ALL SELECT filament_id, ord // 3 - 1, 3, x, y FROM v3 WHERE ord % 3 = 0 AND ord > 0),
    p AS (
      SELECT filament_id, cubic,
        max(x) FILTER (c = 0) AS x0, max(x) FILTER (c = 1) AS x1, max(x) FILTER (c = 2) AS x2, max(x) FILTER (c = 3) AS x3,
        max(y) FILTER (c = 0) AS y0, max(y) FILTER (c = 1) AS y1, max(y) FILTER (c = 2) AS y2, max(y) FILTER (c = 3) AS y3
      FROM m WHERE cubic < 10 GROUP BY ALL),
    q AS (SELECT *, k / 23.0::DOUBLE AS t FROM p, range(0, 24) AS r(k))
    SELECT filament_id, CAST(cubic AS INTEGER) AS cubic, CAST(k AS INTEGER) AS k,
      {r6("power(1 - t, 3) * x0 + 3 * power(1 - t, 2) * t * x1 + 3 * (1 - t) * t * t * x2 + power(t, 3) * x3", "x")},
      {r6("power(1 - t, 3) * y0 + 3 * power(1 - t, 2) * t * y1 + 3 * (1 - t) * t * t * y2 + power(t, 3) * y3", "y")}
    FROM q""",
)
def bezier_flatten(spark: SparkSession, d: str) -> DataFrame:
    """The vertices as consecutive cubics, each starting where the last one ended."""
    cubics = S.curves_arrays(spark, d).select("filament_id", F.posexplode(F.sequence(F.lit(0), F.lit(27), F.lit(3))).alias("cubic", "at"), "points")
    pts = curves.flatten_bezier(*[F.element_at("points", F.col("at") + i + 1) for i in range(4)])
    return rounded(cubics.select("filament_id", "cubic", F.posexplode(pts).alias("k", "p")).select("filament_id", "cubic", "k", "p.*"))


# ---------------------------------------------------------------- statistics


@query("patient_summary", summary_sql(V1_SQL, "v1", "image_id, filament_id"))
def patient_summary(spark: SparkSession, d: str) -> DataFrame:
    m = curves.curve_metrics(S.curves_events(spark, d), S.V1, carry=["patient_id"])
    return rounded(stats.summarize_per_patient(m))


@query("patient_summary_orders", summary_sql(V2_PLAIN, "v2", "image_id, filament_id"))
def patient_summary_orders(spark: SparkSession, d: str) -> DataFrame:
    """Includes two-vertex curves, and drops one-vertex ones."""
    m = curves.curve_metrics(S.curves_orders(spark, d), S.V2, carry=["patient_id"])
    return rounded(stats.summarize_per_patient(m))


BOOTSTRAP_SQL = f"""WITH {V1_SQL}, {metrics_sql("v1", "image_id, filament_id", carry="patient_id")},
  long AS (UNPIVOT (SELECT patient_id, image_id, {", ".join(METRICS)} FROM metrics)
           ON {", ".join(METRICS)} INTO NAME metric VALUE v),
  agg AS (SELECT patient_id, metric, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS sd
          FROM long WHERE isfinite(v) GROUP BY ALL),
  img AS (SELECT patient_id, metric, image_id, sum(v) AS s, count(*) AS c FROM long WHERE isfinite(v) GROUP BY ALL),
  pos AS (SELECT *, row_number() OVER (PARTITION BY patient_id, metric ORDER BY image_id) - 1 AS pos,
          count(*) OVER (PARTITION BY patient_id, metric) AS k FROM img),
  draws AS (SELECT patient_id, metric, b, ('0x' || substr(md5('{stats.BOOT_SEED}:' || b || ':' || pos), 1, 13))::BIGINT % k AS pos
            FROM pos, range(0, {stats.N_BOOT}) AS r(b)),
  means AS (SELECT patient_id, metric, b, sum(s) / sum(c) AS m FROM draws JOIN pos USING (patient_id, metric, pos) GROUP BY ALL),
  q AS (SELECT patient_id, metric, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means GROUP BY ALL)
  SELECT patient_id, metric, n, {r6("mean", "mean")}, {r6("sd", "sd")}, {r6("low", "ci95_low")}, {r6("high", "ci95_high")}
  FROM agg LEFT JOIN q USING (patient_id, metric)"""


@query("patient_summary_bootstrap", BOOTSTRAP_SQL)
def patient_summary_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    m = curves.curve_metrics(S.curves_events(spark, d), S.V1, carry=["patient_id"])
    return rounded(stats.summarize_per_patient(m, bootstrap=True))


# ---------------------------------------------------------------- proximity

# Fixed values for the field view: what counts as the same curve, and as covered.
SAME_CURVE = 0.12
TOLERANCE = 0.06

ODD_EVEN_SQL = FIELD_SQL + """,
  pred AS (SELECT * FROM field WHERE filament_id % 2 = 0),
  gt AS (SELECT * FROM field WHERE filament_id % 2 = 1),
  vv AS (SELECT p.image_id, p.filament_id AS pred_id, g.filament_id AS gt_id, p.ord AS po, g.ord AS go,
                sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) AS d
         FROM pred p JOIN gt g ON p.image_id = g.image_id),
  ab AS (SELECT image_id, pred_id, gt_id, avg(d) AS d FROM
           (SELECT image_id, pred_id, gt_id, po, min(d) AS d FROM vv GROUP BY ALL) GROUP BY ALL),
  ba AS (SELECT image_id, pred_id, gt_id, avg(d) AS d FROM
           (SELECT image_id, pred_id, gt_id, go, min(d) AS d FROM vv GROUP BY ALL) GROUP BY ALL),
  cost AS (SELECT ab.image_id, ab.pred_id, ab.gt_id, 0.5 * (ab.d + ba.d) AS distance
           FROM ab JOIN ba USING (image_id, pred_id, gt_id))"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = S.curves_field(spark, d)
    even = f.filter(F.col("filament_id") % 2 == 0).withColumnRenamed("filament_id", "pred_id")
    odd = f.filter(F.col("filament_id") % 2 == 1).withColumnRenamed("filament_id", "gt_id")
    return even, odd


def _distances(spark: SparkSession, d: str, limit: float = SAME_CURVE) -> DataFrame:
    a, b = _sides(spark, d)
    return proximity.curve_distances(
        a, b, image=["image_id"], ida="pred_id", idb="gt_id", max_distance=limit
    )


@query(
    "curve_distance_pairs",
    f"WITH {ODD_EVEN_SQL} SELECT image_id, pred_id, gt_id, {r6('distance', 'distance')} FROM cost WHERE distance <= {SAME_CURVE}",
)
def curve_distance_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_distances(spark, d))


@query(
    "curve_coverage",
    f"""WITH {FIELD_SQL}, pred AS (SELECT * FROM field WHERE filament_id % 2 = 0),
    gt AS (SELECT * FROM field WHERE filament_id % 2 = 1),
    hit AS (SELECT g.image_id, g.filament_id, g.ord,
              bool_or(sqrt((p.x - g.x) * (p.x - g.x) + (p.y - g.y) * (p.y - g.y)) <= {TOLERANCE}) AS ok
            FROM gt g JOIN pred p ON p.image_id = g.image_id GROUP BY ALL),
    cov AS (SELECT image_id, filament_id AS gt_id, avg(CAST(coalesce(ok, false) AS INTEGER)) AS coverage FROM hit GROUP BY ALL)
    SELECT image_id, gt_id, {r6("coverage", "coverage")}, coverage >= 0.8 AS covered_80pct FROM cov""",
)
def curve_coverage(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    cov = proximity.coverage(b, a, image=["image_id"], filament="gt_id", tolerance=TOLERANCE)
    return rounded(cov.withColumn("covered_80pct", F.col("coverage") >= 0.8))


# Gap and angle of the bridge query, in the field view's units.
BRIDGE_GAP, BRIDGE_ANGLE = 0.25, 60.0


@query(
    "bridge_candidates",
    f"""WITH {FIELD_SQL}, {arc_sql("field", "image_id, filament_id")}, {ENDS_SQL},
    pairs AS (SELECT a.image_id, a.filament_id AS i, a.at_start AS start_i, b.filament_id AS j, b.at_start AS start_j,
                sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap,
                b.x - a.x AS vx, b.y - a.y AS vy, a.dx AS adx, a.dy AS ady, b.dx AS bdx, b.dy AS bdy
              FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.filament_id < b.filament_id)
    SELECT image_id, {r6("gap", "gap")}, i, start_i, j, start_j FROM pairs
    WHERE gap <= {BRIDGE_GAP} AND gap > 0
      AND (adx * vx + ady * vy) / gap >= cos(radians({BRIDGE_ANGLE}))
      AND -(bdx * vx + bdy * vy) / gap >= cos(radians({BRIDGE_ANGLE}))
      AND -(adx * bdx + ady * bdy) >= cos(radians({BRIDGE_ANGLE}))""",
)
def bridge_candidates(spark: SparkSession, d: str) -> DataFrame:
    ends = curves.endpoints(S.curves_field(spark, d), curves.Layout())
    c = proximity.bridge_candidates(
        ends, image=["image_id"], curve="filament_id", max_gap=BRIDGE_GAP, max_angle_deg=BRIDGE_ANGLE
    )
    return rounded(c.select("image_id", "gap", "i", "start_i", "j", "start_j"))


@query(
    "label_claims",
    f"""WITH {FIELD_SQL}, marks AS (
      SELECT vec_id AS label_id, label AS image_id, 0.4::DOUBLE * ((vec_id // 2) % 8) + embedding[1] AS x,
             0.4::DOUBLE * ((vec_id // 2) // 8) + embedding[64] AS y FROM embeddings),
    near AS (SELECT m.image_id, label_id, f.filament_id,
               min(sqrt((m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y))) AS d
             FROM marks m JOIN field f USING (image_id) GROUP BY ALL),
    best AS (SELECT image_id, label_id, min(d) AS distance, arg_min(filament_id, (d, filament_id)) AS nearest FROM near GROUP BY ALL)
    SELECT image_id, label_id, nearest, {r6("distance", "distance")},
           count(*) OVER (PARTITION BY image_id, nearest) > 1 AS duplicated FROM best""",
)
def label_claims(spark: SparkSession, d: str) -> DataFrame:
    f = S.curves_field(spark, d)
    site = F.floor(F.col("vec_id") / 2)
    marks = S.table(spark, d, "embeddings").select(
        F.col("vec_id").alias("label_id"),
        F.col("label").alias("image_id"),
        (F.lit(0.4) * (site % 8) + F.element_at("embedding", 1).cast("double")).alias("x"),
        (F.lit(0.4) * F.floor(site / 8) + F.element_at("embedding", 64).cast("double")).alias("y"),
    )
    near = proximity.nearest_curve(
        marks, f, image=["image_id"], point="label_id", curve="filament_id", start=0.1
    )
    claims = near.groupBy("image_id", "nearest").agg(F.count(F.lit(1)).alias("claims"))
    return rounded(
        near.join(claims, ["image_id", "nearest"]).select(
            "image_id", "label_id", "nearest", "distance", (F.col("claims") > 1).alias("duplicated")
        )
    )


@query(
    "unclaimed_curves",
    f"""WITH {FIELD_SQL}, marks AS (
      SELECT vec_id AS label_id, label AS image_id, 0.4::DOUBLE * ((vec_id // 2) % 8) + embedding[1] AS x,
             0.4::DOUBLE * ((vec_id // 2) // 8) + embedding[64] AS y FROM embeddings),
    near AS (SELECT m.image_id, label_id, f.filament_id,
               min(sqrt((m.x - f.x) * (m.x - f.x) + (m.y - f.y) * (m.y - f.y))) AS d
             FROM marks m JOIN field f USING (image_id) GROUP BY ALL),
    best AS (SELECT image_id, label_id, arg_min(filament_id, (d, filament_id)) AS filament_id FROM near GROUP BY ALL)
    SELECT c.image_id, c.filament_id, count(b.label_id) AS claims
    FROM (SELECT DISTINCT image_id, filament_id FROM field) c LEFT JOIN best b USING (image_id, filament_id) GROUP BY ALL""",
)
def unclaimed_curves(spark: SparkSession, d: str) -> DataFrame:
    near = label_claims(spark, d).select("image_id", "label_id", "nearest")
    return accuracy.label_claims(near, S.curves_field(spark, d), image=["image_id"], curve="filament_id")


# ---------------------------------------------------------------- graph

# Branches between neighbouring customers (and one longer hop), shorter than
# this many hundreds of account balance, close a junction pair.
MERGE_PX = 15.0


@query(
    "merge_junctions",
    f"""WITH RECURSIVE link AS (
      SELECT c_custkey AS src, c_custkey + 1 AS dst FROM customer WHERE abs(c_acctbal) / 100 < {MERGE_PX}
      UNION ALL SELECT c_custkey, c_custkey * 2 FROM customer WHERE abs(c_acctbal - 3000) / 100 < {MERGE_PX} / 2),
    edge AS (SELECT src AS a, dst AS b FROM link UNION SELECT dst, src FROM link),
    reach AS (SELECT DISTINCT a AS node, a AS seen FROM edge
              UNION SELECT r.node, e.b FROM reach r JOIN edge e ON e.a = r.seen)
    SELECT node, min(seen) AS component FROM reach GROUP BY node""",
)
def merge_junctions(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "customer")
    near = c.filter(F.abs("c_acctbal") / 100 < MERGE_PX).select(
        F.col("c_custkey").alias("src"), (F.col("c_custkey") + 1).alias("dst")
    )
    far = c.filter(F.abs(F.col("c_acctbal") - 3000) / 100 < MERGE_PX / 2).select(
        F.col("c_custkey").alias("src"), (F.col("c_custkey") * 2).alias("dst")
    )
    return graph.connected_components(near.unionByName(far))


NODE_SIDE = 0.2

JUNCTION_CTE = f"""{FIELD_SQL}, {arc_sql("field", "image_id, filament_id")}, {ENDS_SQL},
    e AS (SELECT image_id, CAST(floor(x / {NODE_SIDE}) AS BIGINT) AS nx, CAST(floor(y / {NODE_SIDE}) AS BIGINT) AS ny,
                 filament_id * 2 + CASE WHEN at_start THEN 0 ELSE 1 END AS ending, -dx AS dx, -dy AS dy FROM ends),
    q AS (SELECT a.image_id, a.nx, a.ny, a.ending AS a, b.ending AS b, -(a.dx * b.dx + a.dy * b.dy) AS c
          FROM e a JOIN e b ON a.image_id = b.image_id AND a.nx = b.nx AND a.ny = b.ny AND a.ending < b.ending
          WHERE a.ending // 2 <> b.ending // 2)"""
QUALITY = "(c - cos(radians(60))) / (1 - cos(radians(60)))"
JUNCTION_SQL = f"""WITH {JUNCTION_CTE}
    SELECT image_id, nx, ny, a, b, {r6(QUALITY, "quality")} FROM q WHERE c >= cos(radians(60))"""

# Every set of disjoint pairs is listed and the best kept.
MATCHING_CTE = f"""{JUNCTION_CTE},
    sized AS (SELECT q.*, {QUALITY} AS w, row_number() OVER (PARTITION BY image_id, nx, ny ORDER BY {QUALITY} DESC, a, b) AS k
              FROM q WHERE c >= cos(radians(60))),
    sets AS (SELECT DISTINCT image_id, nx, ny, 0::BIGINT AS k, []::BIGINT[] AS used, 0::DOUBLE AS total FROM sized
             UNION ALL
             SELECT m.image_id, m.nx, m.ny, s.k, list_concat(m.used, [s.a, s.b]), m.total + s.w
             FROM sets m JOIN sized s ON s.image_id = m.image_id AND s.nx = m.nx AND s.ny = m.ny AND s.k > m.k
             WHERE NOT list_has_any(m.used, [s.a, s.b])),
    chosen AS (SELECT arg_max(used, total) AS used FROM sets GROUP BY image_id, nx, ny),
    pairs AS (SELECT used[i] AS a, used[i + 1] AS b FROM (SELECT used, unnest(range(1, len(used), 2)) AS i FROM chosen))"""

# Chains are walked from every free end and kept from the lower one; what no walk reaches is a loop.
CHAINS_SQL = f"""WITH RECURSIVE {MATCHING_CTE},
    nb AS (SELECT a AS e, b AS f FROM pairs UNION ALL SELECT b, a FROM pairs),
    walk AS (SELECT e AS entry, e, 0::BIGINT AS pos
             FROM (SELECT unnest([2 * vec_id, 2 * vec_id + 1]) AS e FROM embeddings) WHERE e NOT IN (SELECT e FROM nb)
             UNION ALL SELECT entry, f, pos + 1 FROM walk JOIN nb ON nb.e = xor(walk.e, 1)),
    open_chains AS (SELECT walk.* FROM walk JOIN (SELECT entry, arg_max(xor(e, 1), pos) AS other FROM walk GROUP BY entry) USING (entry) WHERE entry < other),
    ring AS (SELECT 2 * vec_id AS entry, 2 * vec_id AS e, 0::BIGINT AS pos FROM embeddings WHERE vec_id NOT IN (SELECT e // 2 FROM walk)
             UNION ALL SELECT entry, f, pos + 1 FROM ring JOIN nb ON nb.e = xor(ring.e, 1) WHERE f <> entry),
    loops AS (SELECT entry, e, pos FROM (SELECT *, min(e // 2) OVER (PARTITION BY entry) AS low FROM ring) WHERE entry // 2 = low)
    SELECT entry AS chain, pos, e // 2 AS piece, e % 2 = 1 AS flipped FROM (SELECT * FROM open_chains UNION ALL SELECT * FROM loops)"""


def _node_ends(spark: SparkSession, d: str, side: float = NODE_SIDE) -> DataFrame:
    ends = curves.endpoints(S.curves_field(spark, d), curves.Layout())
    return ends.select(
        "image_id",
        F.floor(F.col("x") / side).cast("long").alias("nx"),
        F.floor(F.col("y") / side).cast("long").alias("ny"),
        (F.col("filament_id") * 2 + F.when(F.col("at_start"), 0).otherwise(1)).alias("end"),
        (-F.col("dx")).alias("dx"),
        (-F.col("dy")).alias("dy"),
    )


@query("junction_pairs", JUNCTION_SQL)
def junction_pairs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(junctions.admissible_pairs(_node_ends(spark, d), ["image_id", "nx", "ny"]))


@query("junction_matching", f"WITH RECURSIVE {MATCHING_CTE} SELECT a, b FROM pairs")
def junction_matching(spark: SparkSession, d: str) -> DataFrame:
    return junctions.pair_ends(_node_ends(spark, d), ["image_id", "nx", "ny"])


WIDE_SIDE = 1.0


@query(
    "junction_crowded",
    f"""WITH RECURSIVE {MATCHING_CTE.replace(f"/ {NODE_SIDE})", f"/ {WIDE_SIDE})")}, d AS (SELECT image_id, nx, ny, count(*) AS n_ends FROM e GROUP BY ALL)
    SELECT image_id, nx, ny, n_ends, {r6("coalesce(max(total), 0)", "quality")} FROM d LEFT JOIN sets USING (image_id, nx, ny) GROUP BY ALL""",
)
def junction_crowded(spark: SparkSession, d: str) -> DataFrame:
    """The best total quality of every node where nodes are wide, with ten ends and more."""
    node = ["image_id", "nx", "ny"]
    ends = session.cut_lineage(_node_ends(spark, d, WIDE_SIDE))
    best = junctions.pair_ends(ends, node).join(junctions.admissible_pairs(ends, node), ["a", "b"]).groupBy(*node).agg(F.sum("quality").alias("quality"))
    n = ends.groupBy(*node).agg(F.count(F.lit(1)).alias("n_ends"))
    return rounded(n.join(best, node, "left").select(*node, "n_ends", F.coalesce("quality", F.lit(0.0)).alias("quality")))


@query("curve_chains", CHAINS_SQL)
def curve_chains(spark: SparkSession, d: str) -> DataFrame:
    """Curves strung together through paired junction ends, in order and orientation."""
    pairs = junctions.pair_ends(_node_ends(spark, d), ["image_id", "nx", "ny"])
    pieces = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("piece"))
    return graph.chain_pieces(pieces, pairs)


# ---------------------------------------------------------------- matching and errors


def _matched(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_curves(_distances(spark, d), image=["image_id"], ida="pred_id", idb="gt_id")


def assignment_sql(limit: float) -> str:
    """Every set of feasible pairs that share no curve is listed; the largest, then the shortest, is kept."""
    return f"""WITH RECURSIVE {ODD_EVEN_SQL},
    ok AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pred_id, gt_id) AS k FROM cost WHERE distance <= {limit}),
    sets AS (SELECT DISTINCT image_id, 0::BIGINT AS k, 0::BIGINT AS last, []::BIGINT[] AS used, 0::BIGINT AS n, 0::DOUBLE AS total FROM ok
             UNION ALL SELECT m.image_id, s.k, s.pred_id, list_append(m.used, s.gt_id), m.n + 1, m.total + s.distance
             FROM sets m JOIN ok s ON s.image_id = m.image_id AND s.k > m.k AND (m.n = 0 OR s.pred_id > m.last)
             WHERE NOT list_contains(m.used, s.gt_id)),
    best AS (SELECT image_id, max(n) AS matched, arg_min(total, (-n, total)) AS total_distance FROM sets GROUP BY image_id),
    g AS (SELECT image_id, count(DISTINCT filament_id) AS n_manual FROM gt GROUP BY image_id),
    p AS (SELECT image_id, count(DISTINCT filament_id) AS n_detected FROM pred GROUP BY image_id),
    a AS (SELECT image_id, coalesce(n_manual, 0) AS n_manual, coalesce(n_detected, 0) AS n_detected, coalesce(matched, 0) AS matched, coalesce(total_distance, 0) AS total_distance
          FROM g FULL JOIN p USING (image_id) LEFT JOIN best USING (image_id))
    SELECT image_id, n_manual, n_detected, matched, {r6("total_distance", "total_distance")}, {r6("CASE WHEN n_manual > 0 THEN matched::DOUBLE / n_manual END", "recall")},
      {r6("CASE WHEN n_detected > 0 THEN matched::DOUBLE / n_detected END", "precision_lower_bound")},
      {r6("CASE WHEN matched > 0 THEN n_detected::DOUBLE / matched END", "detections_per_matched_fibril")} FROM a"""


NEAR_CURVE = 0.35


@query("match_crowded", assignment_sql(NEAR_CURVE))
def match_crowded(spark: SparkSession, d: str) -> DataFrame:
    """The assignment where curves have several partners to choose from."""
    a, b = _sides(spark, d)
    near = session.cut_lineage(_distances(spark, d, NEAR_CURVE))
    pairs = matching.match_curves(near, image=["image_id"], ida="pred_id", idb="gt_id")
    return rounded(matching.match_summary(pairs, a, b, image="image_id", ida="pred_id", idb="gt_id"))


@query("match_assignment", assignment_sql(SAME_CURVE))
def match_assignment(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    s = matching.match_summary(_matched(spark, d), a, b, image="image_id", ida="pred_id", idb="gt_id")
    return rounded(s)


@query(
    "nearest_predicted",
    f"""WITH {ODD_EVEN_SQL} SELECT image_id, gt_id, arg_min(pred_id, (distance, pred_id)) AS pred_id,
        {r6("min(distance)", "distance")} FROM cost WHERE distance <= {SAME_CURVE} GROUP BY image_id, gt_id""",
)
def nearest_predicted(spark: SparkSession, d: str) -> DataFrame:
    best = F.min(F.struct("distance", "pred_id")).alias("m")
    near = _distances(spark, d).groupBy("image_id", "gt_id").agg(best)
    return rounded(near.select("image_id", "gt_id", "m.pred_id", "m.distance"))


@query(
    "unmatched",
    f"""WITH {ODD_EVEN_SQL}, ok AS (SELECT * FROM cost WHERE distance <= {SAME_CURVE})
    SELECT 'predicted' AS side, image_id, filament_id FROM (SELECT DISTINCT image_id, filament_id FROM pred)
    WHERE (image_id, filament_id) NOT IN (SELECT image_id, pred_id FROM ok)
    UNION ALL SELECT 'manual', image_id, filament_id FROM (SELECT DISTINCT image_id, filament_id FROM gt)
    WHERE (image_id, filament_id) NOT IN (SELECT image_id, gt_id FROM ok)""",
)
def unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Curves without any feasible partner."""
    a, b = _sides(spark, d)
    near = _distances(spark, d)
    left = matching.unmatched(a, near, image=["image_id"], id_col="pred_id")
    right = matching.unmatched(b, near, image=["image_id"], id_col="gt_id")
    return left.select(F.lit("predicted").alias("side"), "image_id", F.col("pred_id").alias("filament_id")).unionByName(
        right.select(F.lit("manual").alias("side"), "image_id", F.col("gt_id").alias("filament_id"))
    )


RANK_PAIR_SQL = V3_SQL + "," + metrics_sql("v3", "patient_id, filament_id") + """,
  pr AS (SELECT p.*, g.*  FROM (SELECT filament_id // 2 AS site, """ + ", ".join(f"{m} AS {m}_pred" for m in METRICS) + """ FROM metrics WHERE filament_id % 2 = 0) p
         JOIN (SELECT filament_id // 2 AS site2, """ + ", ".join(f"{m} AS {m}_gt" for m in METRICS) + """ FROM metrics WHERE filament_id % 2 = 1) g ON site = site2)"""


def _site_pairs(spark: SparkSession, d: str) -> DataFrame:
    m = curves.curve_metrics(S.curves_vec(spark, d), S.V3).withColumn("site", F.floor(F.col("filament_id") / 2))
    p = m.filter(F.col("filament_id") % 2 == 0).withColumn("pred_id", F.col("filament_id"))
    g = m.filter(F.col("filament_id") % 2 == 1).withColumn("gt_id", F.col("filament_id"))
    pairs = p.select("site", "pred_id").join(g.select("site", "gt_id"), "site").withColumn("distance", F.lit(0.0))
    return accuracy.compare_metrics(pairs, p, g, image=["site"], ida="pred_id", idb="gt_id")


@query(
    "metric_comparison",
    f"""WITH {RANK_PAIR_SQL} SELECT site, site * 2 AS pred_index, site * 2 + 1 AS gt_index, 0.0::DOUBLE AS centerline_distance_px, """
    + ", ".join(
        f"{r6(m + '_pred', m + '_pred')}, {r6(m + '_gt', m + '_gt')}, {r6(f'abs({m}_pred - {m}_gt)', m + '_abs_error')}"
        for m in METRICS
    )
    + " FROM pr",
)
def metric_comparison(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_site_pairs(spark, d))


@query(
    "matched_metric_errors",
    f"WITH {RANK_PAIR_SQL} "
    + " UNION ALL ".join(
        f"""SELECT '{m}' AS metric, count(*) AS n, {r6(f"avg({m}_gt)", "gt_mean")},
        {r6(f"avg(abs({m}_pred - {m}_gt))", "mean_abs_error")}, {r6(f"median(abs({m}_pred - {m}_gt))", "median_abs_error")},
        {r6(f"CASE WHEN count(*) FILTER ({m}_gt = 0) = 0 THEN avg(abs({m}_pred - {m}_gt) / abs({m}_gt)) END", "mean_rel_error")},
        {r6(f"avg({m}_pred - {m}_gt)", "bias")} FROM pr WHERE isfinite({m}_gt) AND isfinite({m}_pred)"""
        for m in METRICS
    ),
)
def matched_metric_errors(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.summarize_errors(_site_pairs(spark, d)))


FOLD_SQL = f"""{ODD_EVEN_SQL},
    ok AS (SELECT DISTINCT image_id, gt_id FROM cost WHERE distance <= {SAME_CURVE}),
    per AS (SELECT image_id, count(*) AS n_manual FROM (SELECT DISTINCT image_id, filament_id FROM gt) GROUP BY ALL),
    hit AS (SELECT image_id, count(*) AS matched FROM ok GROUP BY ALL),
    img AS (SELECT image_id % 5 AS fold, n_manual, coalesce(matched, 0) AS matched FROM per LEFT JOIN hit USING (image_id)),
    folds AS (SELECT fold, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(n_manual) AS BIGINT) AS n_manual,
                     sum(matched) / sum(n_manual) AS recall FROM img GROUP BY fold)"""


def _fold_images(spark: SparkSession, d: str) -> DataFrame:
    _, b = _sides(spark, d)
    hit = _distances(spark, d).select("image_id", "gt_id").distinct().groupBy("image_id").agg(
        F.count(F.lit(1)).alias("matched")
    )
    per = b.groupBy("image_id").agg(F.countDistinct("gt_id").alias("n_manual"))
    return per.join(hit, "image_id", "left").select(
        (F.col("image_id") % 5).alias("fold"),
        "n_manual",
        F.coalesce("matched", F.lit(0).cast("long")).alias("matched"),
    )


@query("fold_recall", f"WITH {FOLD_SQL} SELECT fold, matched, n_manual, {r6('recall', 'recall')} FROM folds")
def fold_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.fold_recall(_fold_images(spark, d)))


@query(
    "pooled_recall",
    f"""WITH {FOLD_SQL} SELECT count(*) AS folds, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(n_manual) AS BIGINT) AS n_manual,
    {r6("sum(matched) / sum(n_manual)", "recall")}, {r6("stddev_pop(recall)", "recall_sd")} FROM folds""",
)
def pooled_recall(spark: SparkSession, d: str) -> DataFrame:
    return rounded(accuracy.pooled_recall(accuracy.fold_recall(_fold_images(spark, d))))


# ---------------------------------------------------------------- rasters


@query(
    "mask_overlap",
    f"""WITH {V4_SQL}, z AS (
      SELECT a.vec_id // 2 AS site, a.v > 0 AS p, b.v > 0 AS t, abs(a.v) > 0.2 AS g
      FROM v4 a JOIN v4 b ON b.vec_id = a.vec_id + 1 AND a.k = b.k WHERE a.vec_id % 2 = 0)
    SELECT site,
      {r6("CASE WHEN count(*) FILTER (p AND NOT g) + count(*) FILTER (t AND NOT g) = 0 THEN 1 ELSE 2 * count(*) FILTER (p AND t AND NOT g) / (count(*) FILTER (p AND NOT g) + count(*) FILTER (t AND NOT g)) END", "dice_labelled", 9)},
      {r6("CASE WHEN count(*) FILTER (p) + count(*) FILTER (t) = 0 THEN 1 ELSE 2 * count(*) FILTER (p AND t) / (count(*) FILTER (p) + count(*) FILTER (t)) END", "dice_all_pixels", 9)},
      {r6("CASE WHEN count(*) FILTER ((p OR t) AND NOT g) = 0 THEN 1 ELSE count(*) FILTER (p AND t AND NOT g) / count(*) FILTER ((p OR t) AND NOT g) END", "iou", 9)},
      {r6("CASE WHEN count(*) FILTER (p OR t) = 0 THEN 1 ELSE count(*) FILTER (p AND t) / count(*) FILTER (p OR t) END", "iou_all_pixels", 9)},
      {r6("count(*) FILTER (g) / count(*)", "ignored_fraction", 9)}, {r6("count(*) FILTER (p) / count(*)", "predicted_fraction", 9)},
      {r6("count(*) FILTER (t) / count(*)", "mask_fraction", 9)}
    FROM z GROUP BY site""",
)
def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    c = S.chips(spark, d).withColumn("site", F.floor(F.col("vec_id") / 2))
    a = c.filter(F.col("vec_id") % 2 == 0).select("site", F.col("px").alias("a"))
    b = c.filter(F.col("vec_id") % 2 == 1).select("site", F.col("px").alias("b"))
    scores = rasters.mask_overlap(
        F.transform("a", lambda v: v > 0),
        F.transform("b", lambda v: v > 0),
        F.transform("a", lambda v: F.abs(v.cast("double")) > 0.2),
    )
    return rounded(a.join(b, "site").select("site", scores.alias("s")).select("site", "s.*"), 9)


NORM_SQL = V4_SQL + """, nq AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v4 GROUP BY ALL),
  norm AS (SELECT v4.vec_id, label, k, y, x, CASE WHEN hi > lo THEN least(greatest((v - lo) / (hi - lo), 0), 1) ELSE 0 END AS v
           FROM v4 JOIN nq USING (vec_id))"""


@query("normalize_percentile", f"WITH {NORM_SQL} SELECT vec_id, CAST(k AS INTEGER) AS pos, {r6('v', 'v')} FROM norm")
def normalize_percentile(spark: SparkSession, d: str) -> DataFrame:
    norm = rasters.normalize_percentile(F.col("px"))
    return rounded(S.chips(spark, d).select("vec_id", F.posexplode(norm).alias("pos", "v")))


@query(
    "min_max_scale",
    f"""WITH {V4_SQL}, b AS (SELECT vec_id, min(v) AS lo, max(v) - min(v) + 1e-9::DOUBLE AS span FROM v4 GROUP BY ALL)
    SELECT vec_id, CAST(k AS INTEGER) AS pos, {r6("(v - lo) / span", "v")}, {r6("1 - (v - lo) / span", "inverted")}
    FROM v4 JOIN b USING (vec_id)""",
)
def min_max_scale(spark: SparkSession, d: str) -> DataFrame:
    c = S.chips(spark, d).withColumn("dpx", F.col("px").cast("array<double>"))
    pairs = F.arrays_zip(
        rasters.min_max_scale(F.col("dpx")).alias("v"),
        rasters.min_max_scale(F.col("dpx"), invert=True).alias("inverted"),
    )
    return rounded(c.select("vec_id", F.posexplode(pairs).alias("pos", "p")).select("vec_id", "pos", "p.*"))


@query(
    "image_quantiles",
    f"""WITH {V4_SQL} SELECT label, count(*) AS n, {r6("quantile_cont(v, 0.01)", "p01")}, {r6("median(v)", "p50")},
        {r6("quantile_cont(v, 0.98)", "p98")}, {r6("quantile_cont(v, 0.99)", "p99")} FROM v4 GROUP BY label""",
)
def image_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact quantiles of all pixels of a label, by narrowing histograms."""
    px = S.chips(spark, d).select("label", F.explode("px").alias("v"))
    q = quantiles.exact_quantiles(px, ["label"], "v", [0.01, 0.5, 0.98, 0.99])
    names = ("p01", "p50", "p98", "p99")
    return rounded(q.select("label", "n", *[F.col("q")[i].alias(c) for i, c in enumerate(names)]))


def block_sql(f: int) -> str:
    return f"""SELECT vec_id, {f} AS factor, CAST(y // {f} AS INTEGER) AS by, CAST(x // {f} AS INTEGER) AS bx, {r6("avg(v)", "v")}
    FROM v4 WHERE y // {f} < 8 // {f} AND x // {f} < 8 // {f} GROUP BY ALL"""


@query("block_average", f"WITH {V4_SQL} {block_sql(2)} UNION ALL {block_sql(3)}")
def block_average(spark: SparkSession, d: str) -> DataFrame:
    c = S.chips(spark, d)
    parts = [
        rasters.block_average(c, ["vec_id"], f).select("vec_id", F.lit(f).alias("factor"), "by", "bx", "v")
        for f in (2, 3)
    ]
    return rounded(parts[0].unionByName(parts[1]))


TILE_SHAPES_SQL = """shapes AS (SELECT c_custkey AS image_id, CAST(40 + c_custkey % 350 AS INTEGER) AS height,
    CAST(40 + (c_custkey * 7) % 350 AS INTEGER) AS width FROM customer)"""


@query(
    "tile_positions",
    f"""WITH {TILE_SHAPES_SQL},
    ys AS (SELECT image_id, unnest(CASE WHEN height <= 128 THEN [0] ELSE list_distinct(list_append(range(0, height - 128 + 1, 96), height - 128)) END) AS y FROM shapes),
    xs AS (SELECT image_id, unnest(CASE WHEN width <= 128 THEN [0] ELSE list_distinct(list_append(range(0, width - 128 + 1, 96), width - 128)) END) AS x FROM shapes)
    SELECT image_id, height, width, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM shapes JOIN ys USING (image_id) JOIN xs USING (image_id)""",
)
def tile_positions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    shapes = S.table(spark, d, "customer").select(
        k.alias("image_id"),
        (F.lit(40) + k % 350).cast("int").alias("height"),
        (F.lit(40) + (k * 7) % 350).cast("int").alias("width"),
    )
    return rasters.tile_positions(shapes, 128, 32)


@query("stitch", f"WITH {V4_SQL} SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6('v', 'v')} FROM v4")
def stitch(spark: SparkSession, d: str) -> DataFrame:
    """Cut into overlapping patches and blend back: the input returns unchanged."""
    p = rasters.extract_patches(S.chips(spark, d), ["vec_id"], 4, 2)
    return rounded(rasters.stitch(p, ["vec_id"], 4))


BLEND_W = "CASE WHEN least({c}, 3 - {c}) < 1 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END"


@query(
    "stitch_weighted",
    f"""WITH {V4_SQL}, corner AS (SELECT unnest([0, 2, 4]) AS c),
    contrib AS (SELECT vec_id, y, x, v * (1 + cy.c + 10 * cx.c) AS v,
                  greatest({BLEND_W.format(c="(y - cy.c)")} * {BLEND_W.format(c="(x - cx.c)")}, 0.001) AS w
                FROM v4, corner cy, corner cx WHERE y BETWEEN cy.c AND cy.c + 3 AND x BETWEEN cx.c AND cx.c + 3)
    SELECT vec_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6("sum(v * w) / sum(w)", "v")} FROM contrib GROUP BY ALL""",
)
def stitch_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Patches that disagree, so the blend weights show."""
    p = rasters.extract_patches(S.chips(spark, d), ["vec_id"], 4, 2)
    gain = F.lit(1) + F.col("y") + F.col("x") * 10
    p = p.withColumn("px", F.transform("px", lambda v: v.cast("double") * gain))
    return rounded(rasters.stitch(p, ["vec_id"], 4))


@query(
    "patch_selection",
    f"""WITH {V4_SQL}, corner AS (SELECT unnest([0, 2, 4]) AS c)
    SELECT vec_id, CAST(cy.c AS INTEGER) AS y, CAST(cx.c AS INTEGER) AS x, CAST(count(*) AS INTEGER) AS positives
    FROM v4, corner cy, corner cx WHERE v4.y BETWEEN cy.c AND cy.c + 3 AND v4.x BETWEEN cx.c AND cx.c + 3 AND v > 0.05
    GROUP BY ALL HAVING count(*) >= 6""",
)
def patch_selection(spark: SparkSession, d: str) -> DataFrame:
    c = S.chips(spark, d).withColumn("mask", F.transform("px", lambda v: v.cast("double") > 0.05))
    return rasters.select_patches(c, ["vec_id"], "mask", patch=4, overlap=2, min_positive=6)


# Curves of V3 drawn on a canvas: x every 12 px, y by value.
DRAW_SQL = V3_SQL + """, canvas AS (
    SELECT filament_id AS image_id, ord, 10 + 12.5::DOUBLE * ord AS x, 60 + 120::DOUBLE * y AS y FROM v3),
  seg AS (SELECT image_id, x AS x0, y AS y0, lead(x) OVER w AS x1, lead(y) OVER w AS y1
          FROM canvas WINDOW w AS (PARTITION BY image_id ORDER BY ord)),
  seg_i AS (SELECT image_id, CAST(round_even(x0, 0) AS BIGINT) AS x0, CAST(round_even(y0, 0) AS BIGINT) AS y0,
                   CAST(round_even(x1, 0) AS BIGINT) AS x1, CAST(round_even(y1, 0) AS BIGINT) AS y1
            FROM seg WHERE x1 IS NOT NULL),
  seg_m AS (SELECT *, greatest(abs(x1 - x0), abs(y1 - y0)) AS mj, least(abs(x1 - x0), abs(y1 - y0)) AS mn,
                   abs(y1 - y0) > abs(x1 - x0) AS steep,
                   CASE WHEN x1 >= x0 THEN 1 ELSE -1 END AS sx, CASE WHEN y1 >= y0 THEN 1 ELSE -1 END AS sy FROM seg_i),
  seg_t AS (SELECT *, unnest(range(0, mj + 1)) AS t FROM seg_m),
  line_px AS (SELECT DISTINCT image_id,
         y0 + sy * CASE WHEN steep THEN t ELSE (2 * t * mn + mj) // greatest(2 * mj, 1) END AS y,
         x0 + sx * CASE WHEN steep THEN (2 * t * mn + mj) // greatest(2 * mj, 1) ELSE t END AS x FROM seg_t),
  clipped AS (SELECT * FROM line_px WHERE y >= 0 AND y < 120 AND x >= 0 AND x < 400)"""


def drawn_segments(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    # A curve leaves some thousand pixels, and those of a part are merged where they are made.
    pixels = 1000 * (S.table(spark, d, "embeddings") if rows is None else rows).count()
    v = spread(S.curves_vec(spark, d, rows), "filament_id", rows=pixels)
    w = Window.partitionBy("filament_id").orderBy("seq")
    # 32 vertices a curve by construction of the view.
    px = v.select(
        F.col("filament_id").alias("image_id"),
        (F.lit(10.0) + F.col("seq") * 12.5).alias("x0"),
        (F.lit(60.0) + F.col("y") * 120.0).alias("y0"),
        F.lead(F.lit(10.0) + F.col("seq") * 12.5).over(w).alias("x1"),
        F.lead(F.lit(60.0) + F.col("y") * 120.0).over(w).alias("y1"),
    )
    return px.filter("x1 is not null").withColumn("height", F.lit(120)).withColumn("width", F.lit(400))


@query(
    "rasterize",
    f"""WITH {DRAW_SQL}, disk AS (SELECT a AS dy, b AS dx FROM range(-1, 2) r(a), range(-1, 2) s(b) WHERE a * a + b * b <= 1),
    grown AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM clipped, disk)
    SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM grown WHERE y >= 0 AND y < 120 AND x >= 0 AND x < 400""",
)
def rasterize(spark: SparkSession, d: str) -> DataFrame:
    return rasters.rasterize(drawn_segments(spark, d), ["image_id"], width_px=3).select("image_id", "y", "x")


# ---------------------------------------------------------------- tables


@query(
    "image_semi_join",
    f"""WITH {V1_SQL} SELECT DISTINCT image_id FROM v1 WHERE image_id IN
        (SELECT user_id % 30 FROM events WHERE value > 300)""",
)
def image_semi_join(spark: SparkSession, d: str) -> DataFrame:
    """Images that have a trace file: here, some curve with a large value."""
    images = S.curves_events(spark, d).select("image_id").distinct()
    traced = S.curves_events(spark, d).filter("y > 300").select("image_id")
    return images.join(traced, "image_id", "left_semi")


MAP_SQL = "SELECT o_custkey AS image_id, count(*) AS n_orders, max(o_totalprice) AS match_score FROM orders WHERE {} GROUP BY ALL"


@query(
    "mapping_upsert",
    f"""WITH old AS ({MAP_SQL.format("o_orderstatus = 'F'")}), new AS ({MAP_SQL.format("o_orderpriority = '1-URGENT'")})
    SELECT coalesce(n.image_id, o.image_id) AS image_id, CASE WHEN n.image_id IS NOT NULL THEN n.n_orders ELSE o.n_orders END AS n_orders,
           {r6("CASE WHEN n.image_id IS NOT NULL THEN n.match_score ELSE o.match_score END", "match_score", 4)}
    FROM old o FULL JOIN new n ON o.image_id = n.image_id""",
)
def mapping_upsert(spark: SparkSession, d: str) -> DataFrame:
    o = S.table(spark, d, "orders")

    def mapping(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("o_custkey").alias("image_id")).agg(
            F.count(F.lit(1)).alias("n_orders"), F.max("o_totalprice").alias("match_score")
        )

    old, new = mapping(o.filter("o_orderstatus = 'F'")), mapping(o.filter("o_orderpriority = '1-URGENT'"))
    return rounded(accuracy.upsert(old, new, "image_id"), 4)


@query(
    "append_union",
    f"""WITH {V1_SQL}, {metrics_sql("v1", "image_id, filament_id", carry="patient_id")}
    SELECT image_id, patient_id, filament_id, {METRIC_COLS}, n_points FROM metrics WHERE image_id < 20
    UNION ALL SELECT image_id, patient_id, filament_id, {METRIC_COLS}, n_points FROM metrics WHERE image_id >= 10""",
)
def append_union(spark: SparkSession, d: str) -> DataFrame:
    """Appending a second run keeps both: overlapping images appear twice."""
    m = curves.curve_metrics(S.curves_events(spark, d), S.V1, carry=["patient_id"])
    cols = ["image_id", "patient_id", "filament_id", *METRICS, "n_points"]
    return rounded(m.filter("image_id < 20").select(cols).unionByName(m.filter("image_id >= 10").select(cols)))


@query(
    "split_three_way",
    """WITH o AS (SELECT image_id, row_number() OVER (ORDER BY md5('0:' || image_id), image_id) - 1 AS place, count(*) OVER () AS n
                  FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings))
    SELECT image_id, CASE WHEN place < n // 5 THEN 'test' WHEN place < n // 5 + n // 5 THEN 'val' ELSE 'train' END AS split FROM o""",
)
def split_three_way(spark: SparkSession, d: str) -> DataFrame:
    ids = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    n = ids.count()
    return splits.split_images(ids, n_val=n // 5, n_test=n // 5, seed=0)


@query(
    "kfold",
    """WITH o AS (SELECT image_id, row_number() OVER (ORDER BY md5('0:' || image_id), image_id) - 1 AS place
                  FROM (SELECT DISTINCT vec_id AS image_id FROM embeddings)),
    f AS (SELECT fold::INTEGER AS fold, image_id, place % 5 = fold AS test FROM o, range(0, 5) AS r(fold)),
    v AS (SELECT *, row_number() OVER (PARTITION BY fold, test ORDER BY md5((fold + 1) || ':' || image_id), image_id) AS k FROM f)
    SELECT fold, image_id, CASE WHEN test THEN 'test' WHEN k <= 6 THEN 'val' ELSE 'train' END AS split FROM v""",
)
def kfold(spark: SparkSession, d: str) -> DataFrame:
    ids = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"))
    return splits.kfold_splits(ids, n_folds=5, n_val=6, seed=0)


# ---------------------------------------------------------------- images drawn from curves

CANVAS_H, CANVAS_W = 120, 400


def drawn_curves(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    """The canvas curves in long form."""
    return S.curves_vec(spark, d, rows).select(
        F.col("filament_id").alias("image_id"),
        F.lit("drawn").alias("filament_id"),
        "seq",
        F.lit(32).cast("long").alias("n"),
        (F.lit(10.0) + F.col("seq") * 12.5).alias("x"),
        (F.lit(60.0) + F.col("y") * 120.0).alias("y"),
        "block",
    )


def drawn_mask(spark: SparkSession, d: str, width_px: int = 5, rows: DataFrame | None = None) -> DataFrame:
    return jobs.drawn_mask(drawn_segments(spark, d, rows), width_px=width_px, tile=DRAW_TILE)


def each_drawn(spark: SparkSession, d: str, work: Callable[[DataFrame], DataFrame], *, fold: int = 1) -> DataFrame:
    """``work`` over all embeddings, in rounds: every drawn image is a case of its own. ``fold``: rounds
    so many times the usual, for work that needs less disk an image."""
    return session.in_rounds(S.table(spark, d, "embeddings"), "vec_id", work, rows=fold * session.ROWS_A_ROUND)


# Tiles smaller than the canvas, so that seams and halos are exercised.
DRAW_TILE = 128


def _as_map(mask: DataFrame) -> DataFrame:
    return tiles.map_tiles(mask, lambda a, _: a.astype("float32"), dtype="uint8", packed=True)


@query(
    "stitch_tiles",
    f"""WITH {DRAW_SQL}, disk AS (SELECT a AS dy, b AS dx FROM range(-2, 3) r(a), range(-2, 3) s(b) WHERE a * a + b * b <= 4),
    grown AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM clipped, disk)
    SELECT image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, 1.0::DOUBLE AS v
    FROM grown WHERE y >= 0 AND y < 120 AND x >= 0 AND x < 400""",
)
def stitch_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles cut into overlapping patches across their seams and blended back."""
    full = _full_grid(_as_map(drawn_mask(spark, d)))
    cut = patches.patches_of(full, patch=64, overlap=16, tile=DRAW_TILE, packed=True)
    back = patches.stitch_patches(cut, patch=64, tile=DRAW_TILE, packed=True)
    return rounded(tiles.tile_pixels(back, dtype="float32").select("image_id", "y", "x", "v"), 3)


def _full_grid(sparse: DataFrame) -> DataFrame:
    """Adds the empty tiles that a sparse mask leaves out. The tiles found are read twice, so they are kept."""
    T_ = DRAW_TILE
    sparse = session.cut_lineage(sparse)
    grid = (
        sparse.select("image_id", "height", "width")
        .distinct()
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("height") - 1) / T_).cast("int"))).alias("ty"))
        .select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("width") - 1) / T_).cast("int"))).alias("tx"))
    )
    found = sparse.select("image_id", "ty", "tx", "pixels")
    h = F.least(F.lit(T_), F.col("height") - F.col("ty") * T_)
    w = F.least(F.lit(T_), F.col("width") - F.col("tx") * T_)
    blank = F.lit(b"")  # no bytes are zeros to whoever reads a tile
    return grid.join(whole(found), ["image_id", "ty", "tx"], "left").select(
        "image_id",
        "ty",
        "tx",
        (F.col("ty") * T_).alias("y0"),
        (F.col("tx") * T_).alias("x0"),
        h.alias("h"),
        w.alias("w"),
        "height",
        "width",
        F.coalesce("pixels", blank).alias("pixels"),
    )


@query(
    "tile_mask_scores",
    f"""WITH {DRAW_SQL}, disk AS (SELECT a AS dy, b AS dx FROM range(-2, 3) r(a), range(-2, 3) s(b) WHERE a * a + b * b <= 4),
    p AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM clipped, disk WHERE y + dy BETWEEN 0 AND 119 AND x + dx BETWEEN 0 AND 399),
    t AS (SELECT DISTINCT image_id, y + dy AS y, x + dx AS x FROM clipped, disk
          WHERE dy * dy + dx * dx <= 1 AND y + dy BETWEEN 0 AND 119 AND x + dx BETWEEN 0 AND 399),
    n AS (SELECT image_id, count(p.y) AS np, count(t.y) AS nt, count(*) FILTER (p.y IS NOT NULL AND t.y IS NOT NULL) AS nb, count(*) AS nu
          FROM p FULL JOIN t USING (image_id, y, x) GROUP BY ALL)
    SELECT image_id, {r6("2 * nb / (np + nt)", "dice_labelled", 12)}, {r6("2 * nb / (np + nt)", "dice_all_pixels", 12)},
           0.0::DOUBLE AS ignored_fraction, {r6("np / (120 * 400)", "predicted_fraction", 12)},
           {r6("nt / (120 * 400)", "mask_fraction", 12)}, {r6("nb / nu", "iou", 12)} FROM n""",
)
def tile_mask_scores(spark: SparkSession, d: str) -> DataFrame:
    wide = tiles.map_tiles(_full_grid(_as_map(drawn_mask(spark, d))), lambda a, _: (a > 0).astype("uint8"))
    narrow = drawn_mask(spark, d, 3)
    return rounded(jobs.mask_scores(wide, narrow, narrow.filter("false")), 12)


def _traced(spark: SparkSession, d: str, rows: DataFrame | None = None) -> DataFrame:
    out = tracer.trace_centerlines(drawn_mask(spark, d, rows=rows), tile=DRAW_TILE)
    return number_curves(out).withColumn("block", curves.block_of(F.col("seq")))


@query("trace_drawn")
def trace_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Drawn curves found again from their pixels, with their descriptors."""
    return each_drawn(spark, d, lambda rows: rounded(curves.curve_metrics(_traced(spark, d, rows), curves.Layout()), 4), fold=4)


# One-pixel lines, a pixel a column, that climb or fall as the 64 numbers say; a gap of two to nine
# pixels from the 28th on. They cross the corner of four tiles.
THIN_TRACE = {"min_branch_px": 10, "bridge_gap_px": 9.0, "bridge_angle_deg": 60.0}
THIN_STEP, THIN_START = 0.08, 28

THIN_SQL = f"""WITH {V4_SQL},
  inked AS (SELECT vec_id AS image_id, CAST(k >= {THIN_START} AS BIGINT) AS filament_id, k AS ord, CAST(96 + k AS DOUBLE) AS x,
              CAST(128 + sum(CASE WHEN v > {THIN_STEP}::DOUBLE THEN 1 WHEN v < -{THIN_STEP}::DOUBLE THEN -1 ELSE 0 END)
                   OVER (PARTITION BY vec_id ORDER BY k) AS DOUBLE) AS y
            FROM v4 QUALIFY k < {THIN_START} OR k >= {THIN_START} + 2 + vec_id % 8),
  traced AS (WITH {resample_sql("inked", "image_id, filament_id")}, {smooth_sql("resampled", "image_id, filament_id")} SELECT * FROM smoothed),
  tips AS (WITH {arc_sql("traced", "image_id, filament_id")}, {ENDS_SQL} SELECT * FROM ends),
  pairs AS (SELECT a.image_id, a.at_start AS start_i, b.at_start AS start_j, sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) AS gap,
              b.x - a.x AS vx, b.y - a.y AS vy, a.dx AS adx, a.dy AS ady, b.dx AS bdx, b.dy AS bdy
            FROM tips a JOIN tips b ON a.image_id = b.image_id AND a.filament_id = 0 AND b.filament_id = 1),
  picked AS (SELECT image_id, start_i, start_j FROM pairs
             WHERE gap <= {THIN_TRACE["bridge_gap_px"]} AND gap > 0
               AND least((adx * vx + ady * vy) / gap, -(bdx * vx + bdy * vy) / gap, -(adx * bdx + ady * bdy)) >= cos(radians({THIN_TRACE["bridge_angle_deg"]}))
             QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY gap, start_i, start_j) = 1),
  sizes AS (SELECT image_id, max(n) FILTER (filament_id = 0) AS n_i FROM traced GROUP BY image_id),
  strung AS (SELECT image_id, 0 AS filament_id, x, y,
               CASE WHEN filament_id = 0 THEN CASE WHEN start_i THEN n - 1 - ord ELSE ord END
                    ELSE n_i + CASE WHEN start_j THEN ord ELSE n - 1 - ord END END AS ord
             FROM traced JOIN picked USING (image_id) JOIN sizes USING (image_id)),
  joined AS (WITH {resample_sql("strung", "image_id, filament_id")}, {smooth_sql("resampled", "image_id, filament_id")} SELECT * FROM smoothed),
  curves AS (SELECT image_id, filament_id, ord, x, y FROM joined
             UNION ALL SELECT image_id, filament_id, ord, x, y FROM traced ANTI JOIN picked USING (image_id)),
  {metrics_sql("curves", "image_id, filament_id")}"""


@query("trace_thin", f"""{THIN_SQL} SELECT image_id, {METRIC_COLS}, n_points FROM metrics""")
def trace_thin(spark: SparkSession, d: str) -> DataFrame:
    """One-pixel lines with a gap traced, bridged where their ends face each other, and measured."""
    step = F.when(F.col("v") > THIN_STEP, 1).when(F.col("v") < -THIN_STEP, -1).otherwise(0)
    climb = Window.partitionBy("image_id").orderBy("k")
    pixels = (
        S.chips(spark, d)
        .select(F.col("vec_id").alias("image_id"), F.posexplode("px").alias("k", "v"))
        .withColumn("v", F.col("v").cast("double"))
        .select(
            "image_id", "k", (F.lit(128) + F.sum(step).over(climb)).cast("int").alias("y"),
            (F.lit(96) + F.col("k")).cast("int").alias("x"), F.lit(256).alias("height"), F.lit(256).alias("width"),
        )
        .filter((F.col("k") < THIN_START) | (F.col("k") >= F.lit(THIN_START + 2) + F.col("image_id") % 8))
    )
    mask = tiles.mask_tiles(pixels.drop("k"), tile=DRAW_TILE)
    found = tracer.trace_centerlines(mask, TraceConfig(**THIN_TRACE), tile=DRAW_TILE)
    out = found.withColumnRenamed("curve", "filament_id").withColumn("block", curves.block_of(F.col("seq")))
    return rounded(curves.curve_metrics(out, curves.Layout())).drop("filament_id")


@query("ridge_drawn")
def ridge_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Mean ridge response on drawn pixels and elsewhere, per image."""

    def work(rows: DataFrame) -> DataFrame:
        image = _full_grid(_as_map(drawn_mask(spark, d, rows=rows)))
        found = ridge.ridge_map(image, invert=False, sigmas=(2.0, 3.0), tile=DRAW_TILE, packed=True)
        on = image.select("image_id", "ty", "tx", F.col("pixels").alias("ink"))

        schema = T.StructType(
            [image.schema["image_id"], *[T.StructField(c, T.DoubleType()) for c in ("on", "off", "n_on", "n_off")]]
        )

        def sums(row: dict) -> list[dict]:
            a = tiles.as_array(row).astype(float)
            ink = tiles.as_array(row, key="ink") > 0
            return [
                {
                    "image_id": row["image_id"],
                    "on": float(a[ink].sum()),
                    "off": float(a[~ink].sum()),
                    "n_on": float(ink.sum()),
                    "n_off": float((~ink).sum()),
                }
            ]

        both = tiles.map_rows(found.join(whole(on), ["image_id", "ty", "tx"]), sums, schema)
        return rounded(
            both.groupBy("image_id").agg(
                ratio(F.sum("on"), F.sum("n_on")).alias("on_mean"), ratio(F.sum("off"), F.sum("n_off")).alias("off_mean")
            ),
            4,
        )

    return each_drawn(spark, d, work, fold=2)


# A curve across each 8 x 8 raster, one vertex a column, and what moves it: five offsets.
CHIP_SNAP = {"max_shift": 1.0, "shift_step": 0.5, "resample_step": 0.25, "jump_penalty": 0.02, "anchor_penalty": 0.01}
CHIP_OFFSETS = (-1.0, -0.5, 0.0, 0.5, 1.0)


def bilinear_sql(x: str, y: str) -> str:
    """Value of the 8 x 8 list ``px`` at (x, y); outside it, 0."""
    x0, y0 = f"CAST(greatest(least(floor({x}), 6), 0) AS BIGINT)", f"CAST(greatest(least(floor({y}), 6), 0) AS BIGINT)"

    def line(row: str) -> str:
        at = f"8 * ({row}) + {x0}"
        return f"(px[{at} + 1]::DOUBLE * (1 - ({x} - {x0})) + px[{at} + 2]::DOUBLE * ({x} - {x0}))"

    return f"""CASE WHEN {x} >= 0 AND {x} <= 7 AND {y} >= 0 AND {y} <= 7 THEN
      {line(y0)} * (1 - ({y} - {y0})) + {line(f"{y0} + 1")} * ({y} - {y0}) ELSE 0 END"""


def path_sql(name: str, src: str, keys: str, pull: float, anchor: str) -> str:
    """CTEs to ``name_path``: keys, ord, p (place among the offsets). ``src``: keys, ord, n, val (list), the anchor."""
    jump = CHIP_SNAP["jump_penalty"]
    numbers = range(1, len(CHIP_OFFSETS) + 1)

    def moved(before: str, to: str) -> str:
        return ", ".join(f"{before}[{i}] + (-{jump}::DOUBLE * abs({CHIP_OFFSETS[i - 1]}::DOUBLE - {to}))" for i in numbers)

    own = ", ".join(f"val[{i}] - {pull}::DOUBLE * abs({o}::DOUBLE - {anchor})" for i, o in enumerate(CHIP_OFFSETS, 1))
    onto = ", ".join(f"s.sc[{j}] + greatest({moved('b.t', f'{o}::DOUBLE')})" for j, o in enumerate(CHIP_OFFSETS, 1))
    offsets = f"[{', '.join(f'{o}::DOUBLE' for o in CHIP_OFFSETS)}]"
    return f"""{name}_own AS (SELECT {keys}, ord, n, [{own}] AS sc FROM {src}),
  {name}_tot AS (SELECT {keys}, ord, n, sc AS t FROM {name}_own WHERE ord = 0
    UNION ALL SELECT s.{keys}, s.ord, s.n, [{onto}] FROM {name}_tot b JOIN {name}_own s ON s.{keys} = b.{keys} AND s.ord = b.ord + 1),
  {name}_path AS (SELECT {keys}, ord, list_position(t, list_max(t)) AS p FROM {name}_tot WHERE ord = n - 1
    UNION ALL SELECT {keys}, ord, list_position(m, list_max(m)) FROM (
      SELECT b.{keys}, b.ord, [{moved('b.t', f'{offsets}[a.p]')}] AS m
      FROM {name}_path a JOIN {name}_tot b ON b.{keys} = a.{keys} AND b.ord = a.ord - 1))"""


SNAP_SQL = f"""WITH RECURSIVE {V4_SQL},
  line AS (SELECT vec_id, x AS ord, CAST(x AS DOUBLE) AS x, 3.5::DOUBLE + 4 * v AS y FROM v4 WHERE y = 3),
  {resample_sql("line", "vec_id", "0.25")},
  near AS (SELECT *, lead(x) OVER w AS xn, lead(y) OVER w AS yn, lag(x) OVER w AS xp, lag(y) OVER w AS yp
           FROM resampled WINDOW w AS (PARTITION BY vec_id ORDER BY ord)),
  slope AS (SELECT *, (coalesce(xn, x) - coalesce(xp, x)) / CASE WHEN xn IS NULL OR xp IS NULL THEN 1 ELSE 2 END AS tx,
                   (coalesce(yn, y) - coalesce(yp, y)) / CASE WHEN xn IS NULL OR xp IS NULL THEN 1 ELSE 2 END AS ty FROM near),
  base AS (SELECT vec_id, ord, n, x, y, embedding AS px,
             CASE WHEN tx <> 0 OR ty <> 0 THEN -ty / sqrt(tx * tx + ty * ty) ELSE 0 END AS nx,
             CASE WHEN tx <> 0 OR ty <> 0 THEN tx / sqrt(tx * tx + ty * ty) ELSE 0 END AS ny
           FROM slope JOIN embeddings USING (vec_id)),
  val AS (SELECT vec_id, ord, n, x, y, nx, ny, [{", ".join(bilinear_sql(f"(x + {o}::DOUBLE * nx)", f"(y + {o}::DOUBLE * ny)") for o in CHIP_OFFSETS)}] AS val
          FROM base),
  {path_sql("one", "val", "vec_id", snap.TIE_BREAK, "0::DOUBLE")},
  o AS (SELECT [{", ".join(f"{o}::DOUBLE" for o in CHIP_OFFSETS)}] AS o),
  mid AS (SELECT vec_id, median(o[p]) AS anchor FROM one_path, o GROUP BY vec_id),
  val2 AS (SELECT val.*, anchor FROM val JOIN mid USING (vec_id)),
  {path_sql("two", "val2", "vec_id", CHIP_SNAP["anchor_penalty"], "anchor")},
  moved AS (SELECT vec_id, ord, n, x + o[p] * nx AS x, y + o[p] * ny AS y, o[p] AS off
            FROM val JOIN two_path USING (vec_id, ord), o),
  {smooth_sql("moved", "vec_id", 9)},
  spread AS (SELECT vec_id, count(*) AS n, median(off) AS offset_median, quantile_cont(off, 0.75) - quantile_cont(off, 0.25) AS offset_spread,
                    sum(off * (ord + 1)) AS offset_moment FROM moved GROUP BY vec_id),
  before AS (SELECT vec_id, avg(val[3]) AS score_before FROM val GROUP BY vec_id),
  after AS (SELECT vec_id, avg(v) AS score_after FROM
              (SELECT vec_id, {bilinear_sql("x", "y")} AS v FROM (SELECT s.vec_id, s.x, s.y, embedding AS px FROM smoothed s JOIN embeddings USING (vec_id)))
            GROUP BY vec_id)"""


@query(
    "snap_chips",
    f"""{SNAP_SQL}
    SELECT vec_id AS image_id, n, {r6("offset_median", "offset_median")}, {r6("offset_spread", "offset_spread")},
           {r6("offset_moment", "offset_moment")}, {r6("score_before", "score_before")}, {r6("score_after", "score_after")},
           {r6("CASE WHEN score_before > 0 THEN score_after / score_before ELSE CAST('inf' AS DOUBLE) END", "gain")}
    FROM spread JOIN before USING (vec_id) JOIN after USING (vec_id)""",
)
def snap_chips(spark: SparkSession, d: str) -> DataFrame:
    """A curve across each 8 x 8 raster snapped in two passes; offsets and response per curve."""
    chips = S.chips(spark, d).withColumnRenamed("vec_id", "image_id")
    x = F.posexplode(F.slice("px", 25, 8)).alias("seq", "v")
    line = chips.select("image_id", F.col("image_id").alias("filament_id"), x).select(
        "image_id", "filament_id", F.col("seq").cast("long").alias("seq"), F.col("seq").cast("double").alias("x"),
        (F.lit(3.5) + F.lit(4.0) * F.col("v").cast("double")).alias("y"), F.lit(0).cast("long").alias("block"),
    )
    snapped, quality = snap.snap_to_ridge(line, tiles.cut_tiles(chips, tile=DRAW_TILE), tile=DRAW_TILE, **CHIP_SNAP)
    offsets = snapped.groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("offset") * (F.col("seq") + 1)).alias("offset_moment")
    )
    middle = quantiles.exact_quantiles(snapped, ["image_id"], "offset", [0.5]).select(
        "image_id", F.col("q")[0].alias("offset_median")
    )
    return rounded(quality.drop("filament_id").join(offsets, "image_id").join(middle, "image_id"))


# Scales of the ridge map over the 8 x 8 rasters; the wider kernel mirrors a whole raster.
CHIP_SIGMAS = (1.0, 2.0)

RIDGE_SQL = f"""WITH {V4_SQL},
  ends AS (SELECT vec_id, min(v) AS low, max(v) AS high FROM v4 GROUP BY vec_id),
  flat AS (SELECT vec_id, y, x, CAST((CAST(v AS FLOAT) - CAST(low AS FLOAT)) / CAST(high - low + 1e-9::DOUBLE AS FLOAT) AS DOUBLE) AS v
           FROM v4 JOIN ends USING (vec_id)),
  boxes AS (SELECT vec_id, list(v ORDER BY y, x) AS px FROM flat GROUP BY vec_id),
  near AS (SELECT vec_id, y, x, v, dy, dx,
             CASE WHEN y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7 THEN px[8 * (y + dy) + x + dx + 1] ELSE 0 END AS w
           FROM flat JOIN boxes USING (vec_id), range(-6, 7) AS a(dy), range(-6, 7) AS b(dx)),
  calm AS (SELECT vec_id, y, x, CAST(CAST(sum(k * w) / sum(k) AS FLOAT) AS DOUBLE) AS v
           FROM (SELECT *, exp(-0.5::DOUBLE * power((w - v) / {ridge.SIGMA_COLOR}::DOUBLE, 2)
                               - 0.5::DOUBLE * (dy * dy + dx * dx) / power({ridge.SIGMA_SPATIAL}::DOUBLE, 2)) AS k FROM near)
           GROUP BY ALL),
  raw_k AS (SELECT s, t, exp(-0.5::DOUBLE * power(t / s, 2)) AS g
            FROM (SELECT unnest([{", ".join(f"{s}::DOUBLE" for s in CHIP_SIGMAS)}]) AS s), range(-8, 9) AS r(t) WHERE abs(t) <= 4 * s),
  kern AS (SELECT s, t, g / sum(g) OVER (PARTITION BY s) AS g FROM raw_k),
  fold AS (SELECT s, i, CASE WHEN i + t < 0 THEN -1 - i - t WHEN i + t > 7 THEN 15 - i - t ELSE i + t END AS j,
                  sum(g) AS g, sum(-t / (s * s) * g) AS d, sum((t * t / power(s, 4) - 1 / (s * s)) * g) AS dd
           FROM kern, range(0, 8) AS r(i) GROUP BY ALL),
  hess AS (SELECT c.vec_id, a.s, a.i AS y, b.i AS x, a.s * a.s * sum(a.dd * b.g * c.v) AS yy,
                  a.s * a.s * sum(a.g * b.dd * c.v) AS xx, a.s * a.s * sum(a.d * b.d * c.v) AS xy
           FROM calm c JOIN fold a ON a.j = c.y JOIN fold b ON b.j = c.x AND b.s = a.s GROUP BY c.vec_id, a.s, a.i, b.i),
  roots AS (SELECT *, 0.5::DOUBLE * (xx + yy) AS m, sqrt(power(0.5::DOUBLE * (xx - yy), 2) + xy * xy) AS r FROM hess),
  eig AS (SELECT *, CASE WHEN abs(m + r) > abs(m - r) THEN m - r ELSE m + r END AS small,
                 CASE WHEN abs(m + r) > abs(m - r) THEN m + r ELSE m - r END AS large FROM roots),
  half AS (SELECT vec_id, s, CASE WHEN max(small * small + large * large) > 0 THEN 0.5::DOUBLE * sqrt(max(small * small + large * large)) ELSE 1 END AS half
           FROM eig GROUP BY ALL),
  best AS (SELECT vec_id, y, x, CAST(max(exp(-0.5::DOUBLE * power(abs(small) / greatest(-large, 1e-10::DOUBLE) / {ridge.BETA}::DOUBLE, 2))
                 * (1 - exp(-0.5::DOUBLE * (small * small + large * large) / (half * half)))) AS FLOAT) AS v
           FROM eig JOIN half USING (vec_id, s) GROUP BY ALL),
  found AS (SELECT vec_id, y, x, CAST(v / CAST(CAST(max(v) OVER (PARTITION BY vec_id) AS DOUBLE) + 1e-9::DOUBLE AS FLOAT) AS DOUBLE) AS v FROM best)"""


def _chip_ridge(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cut = tiles.cut_tiles(S.chips(spark, d).withColumnRenamed("vec_id", "image_id"), tile=DRAW_TILE)
    return cut, ridge.ridge_map(cut, invert=False, sigmas=CHIP_SIGMAS, tile=DRAW_TILE)


@query(
    "ridge_chips",
    f"""{RIDGE_SQL} SELECT vec_id AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x, {r6("v", "v", 5)} FROM found WHERE v <> 0""",
)
def ridge_chips(spark: SparkSession, d: str) -> DataFrame:
    """Scaled, denoised and multiscale ridge map of the 8 x 8 rasters, pixel by pixel."""
    _, found = _chip_ridge(spark, d)
    return rounded(tiles.tile_pixels(found, dtype="float32").select("image_id", "y", "x", "v"), 5)


IGNORE_SQL = RIDGE_SQL + """,
  cuts AS (SELECT vec_id, quantile_cont(v, 0.9) AS cut FROM found GROUP BY vec_id),
  marked AS (SELECT vec_id, y, x FROM v4 WHERE v > 0.1::DOUBLE),
  seeds AS (SELECT f.vec_id, f.y, f.x FROM found f JOIN cuts USING (vec_id) ANTI JOIN marked m ON m.vec_id = f.vec_id AND m.y = f.y AND m.x = f.x WHERE v > cut),
  grown AS (SELECT DISTINCT vec_id, y + dy AS y, x + dx AS x FROM seeds, range(-2, 3) AS a(dy), range(-2, 3) AS b(dx)
            WHERE dy * dy + dx * dx <= 4 AND y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7),
  unknown AS (SELECT g.vec_id, g.y, g.x FROM grown g ANTI JOIN marked m ON m.vec_id = g.vec_id AND m.y = g.y AND m.x = g.x)"""


def _chip_labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pixels above 0.1 count as marked; ridges that nobody marked are unknown."""
    cut, found = _chip_ridge(spark, d)
    marked = tiles.map_tiles(cut, lambda a, _: (a.astype(float) > 0.1).astype("uint8"))
    return marked, ridge.ignore_mask(found, marked, quantile=0.9, dilation=2, tile=DRAW_TILE)


@query("ignore_chips", f"{IGNORE_SQL} SELECT vec_id AS image_id, CAST(y AS INTEGER) AS y, CAST(x AS INTEGER) AS x FROM unknown")
def ignore_chips(spark: SparkSession, d: str) -> DataFrame:
    """Ridge-like pixels that nobody marked, grown by a disk."""
    return tiles.tile_pixels(_chip_labels(spark, d)[1]).select("image_id", "y", "x")


@query(
    "label_totals_chips",
    f"""{IGNORE_SQL}, n AS (SELECT 64 * count(DISTINCT vec_id) AS pixels, count(DISTINCT vec_id) AS n_fibrils FROM embeddings)
    SELECT {r6("(SELECT count(*) FROM marked) / pixels", "positive_fraction", 9)},
           {r6("(SELECT count(*) FROM unknown) / pixels", "ignored_fraction", 9)}, n_fibrils FROM n""",
)
def label_totals_chips(spark: SparkSession, d: str) -> DataFrame:
    """Shares of marked and unknown pixels over all rasters, and the number of their curves."""
    counts = jobs.mask_counts(*_chip_labels(spark, d))
    lines = S.curves_arrays(spark, d).select(F.col("filament_id").alias("image_id"), "filament_id")
    return rounded(jobs.label_totals(counts, lines), 9)


@query("snap_drawn")
def snap_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Curves moved six pixels off their own blurred image and snapped back."""

    def work(rows: DataFrame) -> DataFrame:
        soft = ridge.blur_tiles(_full_grid(_as_map(drawn_mask(spark, d, rows=rows))), 2.0, tile=DRAW_TILE, packed=True)
        off = drawn_curves(spark, d, rows).withColumn("y", F.col("y") + 6.0)
        _, quality = snap.snap_to_ridge(off, session.cut_lineage(soft), max_shift=10.0, tile=DRAW_TILE)
        return rounded(quality, 4)

    return each_drawn(spark, d, work)


@query("validate_drawn")
def validate_drawn(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy job per image: traced curves against the ones that were drawn."""

    def work(rows: DataFrame) -> DataFrame:
        prob = session.cut_lineage(_full_grid(_as_map(drawn_mask(spark, d, rows=rows))))
        narrow = drawn_mask(spark, d, 3, rows)
        manual = curves.resample(drawn_curves(spark, d, rows), curves.Layout())
        out = jobs.validate(prob, narrow, narrow.filter("false"), manual, tile=DRAW_TILE)
        return rounded(out["per_image"], 4)

    return each_drawn(spark, d, work)


# ---------------------------------------------------------------- correlation and loss

CORR_SQL = V4_SQL + """,
  shot_raw AS (SELECT vec_id, label, k, y, x, round(v * 10) / 10 AS v FROM v4),
  cq AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM v4 GROUP BY ALL),
  sq AS (SELECT vec_id, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM shot_raw GROUP BY ALL),
  cn AS (SELECT vec_id, k, least(greatest((v - lo) / (hi - lo + 1e-9::DOUBLE), 0), 1) AS v FROM v4 JOIN cq USING (vec_id)),
  sn AS (SELECT vec_id, k, least(greatest((v - lo) / (hi - lo + 1e-9::DOUBLE), 0), 1) AS v FROM shot_raw JOIN sq USING (vec_id)),
  cz AS (SELECT vec_id, k, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9::DOUBLE) AS z FROM cn WINDOW w AS (PARTITION BY vec_id)),
  sz AS (SELECT vec_id, k, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-9::DOUBLE) AS z FROM sn WINDOW w AS (PARTITION BY vec_id)),
  score AS (SELECT c.vec_id AS image_id, s.vec_id AS shot_id, avg(c.z * s.z) AS score FROM cz c JOIN sz s ON c.k = s.k GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, shot_id DESC) AS r FROM score)"""


@query(
    "correlation_top2",
    f"""WITH {CORR_SQL} SELECT image_id, max(shot_id) FILTER (r = 1) AS best_id, {r6("max(score) FILTER (r = 1)", "best_score", 5)},
    max(shot_id) FILTER (r = 2) AS runner_up_id, {r6("max(score) FILTER (r = 2)", "runner_up_score", 5)},
    max(score) FILTER (r = 1) >= 0.85 AS matched FROM top WHERE r <= 2 GROUP BY image_id""",
)
def correlation_top2(spark: SparkSession, d: str) -> DataFrame:
    """Every raster against the coarsely quantised copies of all rasters."""
    c = S.chips(spark, d).withColumn("px", F.col("px").cast("array<double>"))
    norm = rasters.normalize_percentile(F.col("px"), eps=1e-9)
    coarse = c.withColumn("px", F.transform("px", lambda v: F.round(v * 10) / 10))
    images = c.select(F.col("vec_id").alias("image_id"), norm.alias("px"))
    shots = coarse.select(F.col("vec_id").alias("shot_id"), norm.alias("px"))
    best = micrographs.top_two(images, shots)
    return rounded(best.withColumn("matched", F.col("best_score") >= micrographs.MATCH_THRESHOLD), 5)


MASKED_SQL = CORR_SQL[: CORR_SQL.index("  cz AS")] + """
  ice AS (SELECT vec_id AS image_id, k FROM cn WHERE v >= 0.42),
  met AS (SELECT c.vec_id AS image_id, s.vec_id AS shot_id, c.v AS a, s.v AS b
           FROM cn c JOIN ice i ON i.image_id = c.vec_id AND i.k = c.k JOIN sn s ON s.k = c.k),
  m AS (SELECT image_id, shot_id, avg(a) AS ma, avg(b) AS mb, stddev_pop(a) + 1e-9::DOUBLE AS sa, stddev_pop(b) + 1e-9::DOUBLE AS sb FROM met GROUP BY ALL),
  score AS (SELECT image_id, shot_id, avg((a - ma) / sa * (b - mb) / sb) AS score FROM met JOIN m USING (image_id, shot_id) GROUP BY ALL),
  top AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, shot_id DESC) AS r FROM score)"""


@query(
    "correlation_masked_top2",
    f"""WITH {MASKED_SQL} SELECT image_id, max(shot_id) FILTER (r = 1) AS best_id, {r6("max(score) FILTER (r = 1)", "best_score", 5)},
    max(shot_id) FILTER (r = 2) AS runner_up_id, {r6("max(score) FILTER (r = 2)", "runner_up_score", 5)}
    FROM top WHERE r <= 2 GROUP BY image_id""",
)
def correlation_masked_top2(spark: SparkSession, d: str) -> DataFrame:
    """The same over the bright pixels of each raster only, as carbon film is left out."""
    c = S.chips(spark, d).withColumn("px", F.col("px").cast("array<double>"))
    norm = rasters.normalize_percentile(F.col("px"), eps=1e-9)
    coarse = c.withColumn("px", F.transform("px", lambda v: F.round(v * 10) / 10))
    images = c.select(F.col("vec_id").alias("image_id"), norm.alias("px")).withColumn("ice", F.transform("px", lambda v: v >= micrographs.CARBON_LEVEL))
    return rounded(micrographs.top_two(images, coarse.select(F.col("vec_id").alias("shot_id"), norm.alias("px")), mask="ice"), 5)


@query(
    "dice_bce",
    f"""WITH {V4_SQL}, z AS (SELECT a.label, a.v * 10 AS x, CAST(b.v > 0 AS INTEGER) AS t, CAST(abs(b.v) <= 0.2 AS INTEGER) AS w
      FROM v4 a JOIN v4 b ON b.vec_id = a.vec_id + 1 AND a.k = b.k WHERE a.vec_id % 2 = 0),
    p AS (SELECT *, (1 - t) * x + (1 + 9 * t) * (ln(1 + exp(-abs(x))) + greatest(-x, 0)) AS bce, w / (1 + exp(-x)) AS prob FROM z)
    SELECT label, count(*) AS n, {r6("sum(bce * w) / greatest(sum(w), 1e-6) + 1 - (2 * sum(prob * t * w) + 1e-6) / (sum(prob) + sum(t * w) + 1e-6)", "loss")}
    FROM p GROUP BY label""",
)
def dice_bce(spark: SparkSession, d: str) -> DataFrame:
    c = S.chips(spark, d)
    px = rasters.to_pixels(c, ["vec_id", "label"])
    a = px.filter(F.col("vec_id") % 2 == 0)
    b = px.filter(F.col("vec_id") % 2 == 1).select((F.col("vec_id") - 1).alias("vec_id"), "y", "x", F.col("v").alias("u"))
    both = a.join(b, ["vec_id", "y", "x"])
    loss = patches.dice_bce(
        F.col("v") * 10, (F.col("u") > 0).cast("double"), (F.abs("u") <= 0.2).cast("double")
    )
    return rounded(both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), loss.alias("loss")))
