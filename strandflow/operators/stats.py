"""Per-patient statistics with t-based or image-level bootstrap intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.functions.expr import finite
from strandflow.functions.student import t_factor
from strandflow.operators.numbering import number_rows
from strandflow.schema import METRICS
from strandflow.session import cut_lineage

# Resample count, seed and level of the bootstrap interval.
N_BOOT = 2000
BOOT_SEED = 0
ALPHA = 0.05


def _metrics_of(per_image: DataFrame, metrics: Sequence[str] | None) -> list[str]:
    return list(metrics) if metrics else [m for m in METRICS if m in per_image.columns]


def summarize_per_patient(
    per_image: DataFrame,
    *,
    metrics: Sequence[str] | None = None,
    bootstrap: bool = False,
    group_col: str = "image_id",
) -> DataFrame:
    """n, mean, sample sd and 95% interval for each (patient, metric).

    Non-finite values are left out, null patients drop out, undefined statistics
    are NULL. All metrics are aggregated in one pass over the curves and only
    the per-patient result is turned into rows.
    """
    names = _metrics_of(per_image, metrics)
    clean = per_image.filter(F.col("patient_id").isNotNull())
    aggs = []
    for m in names:
        v = finite(F.col(m))
        aggs += [
            F.count(v).alias(f"n_{m}"),
            F.avg(v).alias(f"mean_{m}"),
            F.stddev_samp(v).alias(f"sd_{m}"),
        ]
    items = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"n_{m}").alias("n"),
                F.col(f"mean_{m}").alias("mean"),
                F.col(f"sd_{m}").alias("sd"),
            )
            for m in names
        ]
    )
    stats = (
        clean.groupBy("patient_id").agg(*aggs).select("patient_id", F.explode(items).alias("s"))
    ).select("patient_id", "s.*")
    if bootstrap and group_col in per_image.columns:
        bounds = bootstrap_bounds(clean, names, group_col)
        return stats.join(bounds, ["patient_id", "metric"], "left")
    half = t_factor(F.col("n") - 1, ALPHA) * F.col("sd") / F.sqrt(F.col("n").cast("double"))
    one = F.col("n") == 1
    return stats.withColumn("half", F.when(F.col("n") > 1, half)).select(
        "patient_id",
        "metric",
        "n",
        "mean",
        "sd",
        F.when(one, F.col("mean")).otherwise(F.col("mean") - F.col("half")).alias("ci95_low"),
        F.when(one, F.col("mean")).otherwise(F.col("mean") + F.col("half")).alias("ci95_high"),
    )


def draw_place(b: Column, j: Column, k: Column) -> Column:
    """Which of ``k`` images draw ``j`` of resample ``b`` takes: a seeded hash, the same in every engine."""
    text = F.concat_ws(":", F.lit(BOOT_SEED), b, j)
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") % k


def bootstrap_bounds(per_image: DataFrame, metrics: Sequence[str], group_col: str = "image_id") -> DataFrame:
    """Percentile interval of the mean, resampling whole images.

    A resample only needs each image's sum and count, so curves are reduced to
    one row per image first. Metrics that are defined on the same images of a
    patient share their draws. Each image then asks, for every resample, for the
    image drawn in its stead; draws meet the images they name by place, and the
    sums of all metrics are added map side. Work is spread over (image,
    resample), whatever a group's size.
    """
    values = []
    for m in metrics:
        v = finite(F.col(m))
        values += [F.sum(v).alias(f"s_{m}"), F.count(v).alias(f"c_{m}")]
    images = cut_lineage(
        per_image.groupBy("patient_id", group_col).agg(*values).withColumnRenamed(group_col, "image")
    )
    has = {m: F.col(f"c_{m}") > 0 for m in metrics}

    def first_alike(k: int) -> Column:
        """The first metric that is defined on just the images where metric ``k`` is."""
        alike = [
            F.when(F.bool_and(has[m] == has[metrics[k]]), F.lit(m)) for m in metrics[:k]
        ]
        return F.coalesce(*alike, F.lit(metrics[k])).alias(metrics[k])

    leads = images.groupBy("patient_id").agg(*[first_alike(k) for k in range(len(metrics))])
    shared = leads.select(
        "patient_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("lead")) for m in metrics])).alias("l")
    ).select("patient_id", "l.*")
    group = ["patient_id", "lead"]
    sums = [c for m in metrics for c in (f"s_{m}", f"c_{m}")]
    members = (
        images.join(shared.select(*group).distinct(), "patient_id")
        .filter(F.coalesce(*[F.when(F.col("lead") == m, has[m]) for m in metrics]))
        .select(*group, "image", *sums)
    )
    placed = cut_lineage(number_rows(members, group, ["image"], "pos"))
    sizes = placed.groupBy(*group).agg(F.count(F.lit(1)).alias("k"))
    draws = (
        placed.select(*group, "pos")
        .join(sizes, group)
        .select(*group, "pos", "k", F.explode(F.sequence(F.lit(0), F.lit(N_BOOT - 1))).alias("b"))
        .select(*group, "b", draw_place(F.col("b"), F.col("pos"), F.col("k")).alias("pos"))
    )
    totals = draws.join(placed.drop("image"), [*group, "pos"]).groupBy(*group, "b").agg(*[F.sum(c).alias(c) for c in sums])
    each = F.array(
        *[F.struct(F.lit(m).alias("metric"), (F.col(f"s_{m}") / F.nullif(F.col(f"c_{m}"), F.lit(0))).alias("mean")) for m in metrics]
    )
    means = (
        totals.select(*group, F.explode(each).alias("e"))
        .select(*group, "e.*")
        .join(shared, ["patient_id", "lead", "metric"], "left_semi")
    )
    q = F.percentile("mean", F.array(F.lit(ALPHA / 2), F.lit(1 - ALPHA / 2)))
    return (
        means.groupBy("patient_id", "metric")
        .agg(q.alias("q"))
        .select("patient_id", "metric", F.col("q")[0].alias("ci95_low"), F.col("q")[1].alias("ci95_high"))
    )
