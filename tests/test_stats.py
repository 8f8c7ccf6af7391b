from __future__ import annotations

import hashlib

import numpy as np
import pytest
from helpers import float_tiles

from strandflow.functions.student import t_quantile
from strandflow.operators.quantiles import exact_quantiles, tile_quantiles
from strandflow.operators.stats import BOOT_SEED, N_BOOT, summarize_per_patient


def test_t_factor_published_values():
    # Published two-sided 95% points of Student's t.
    known = {1: 12.7062047, 2: 4.3026527, 3: 3.1824463, 10: 2.2281389, 30: 2.0422725, 100: 1.9839715}
    got = t_quantile(np.array(list(known), dtype=float), 0.025)
    np.testing.assert_allclose(got, list(known.values()), atol=1e-6)
    assert t_quantile(np.array([1e7]), 0.025)[0] == pytest.approx(1.959964, abs=1e-5)


def frame(spark):
    rows = [("P1", f"i{k % 2}", 10.0 + 2 * k) for k in range(4)]
    rows += [("P2", f"i{k}", 20.0 + 2 * k) for k in range(3)]
    rows += [("P3", "i9", 5.0), ("P4", "i9", float("nan")), (None, "i9", 1.0), ("P1", "i0", float("inf"))]
    return spark.createDataFrame(rows, "patient_id string, image_id string, length double")


def test_summary(spark):
    got = {r["patient_id"]: r for r in summarize_per_patient(frame(spark)).collect()}
    assert set(got) == {"P1", "P2", "P3", "P4"}
    p1 = got["P1"]
    assert (p1["n"], p1["mean"]) == (4, 13.0)
    half = 3.182446305284263 * p1["sd"] / 2
    assert p1["ci95_low"] == pytest.approx(13 - half) and p1["ci95_high"] == pytest.approx(13 + half)
    assert got["P3"]["ci95_low"] == 5.0 == got["P3"]["ci95_high"] and got["P3"]["sd"] is None
    assert got["P4"]["n"] == 0 and got["P4"]["mean"] is None and got["P4"]["ci95_low"] is None


def test_metric_subset_and_missing_group(spark):
    df = frame(spark).drop("image_id")
    got = summarize_per_patient(df, metrics=["length"], bootstrap=True)
    assert {r["metric"] for r in got.collect()} == {"length"}


def test_bootstrap_matches_direct_resampling(spark):
    rng = np.random.default_rng(5)
    rows = [("P", f"img{k % 5}", float(v)) for k, v in enumerate(rng.normal(10, 3, 23))] + [("Q", "a", 1.0)]
    df = spark.createDataFrame(rows, "patient_id string, image_id string, length double")
    got = {r["patient_id"]: r for r in summarize_per_patient(df, bootstrap=True).collect()}
    groups: dict[str, list[float]] = {}
    for p, i, v in rows:
        if p == "P":
            groups.setdefault(i, []).append(v)
    names, means = sorted(groups), []
    for b in range(N_BOOT):
        drawn = [names[int(hashlib.md5(f"{BOOT_SEED}:{b}:{j}".encode()).hexdigest()[:13], 16) % 5] for j in range(5)]
        means.append(np.mean([v for name in drawn for v in groups[name]]))
    low, high = np.percentile(means, [2.5, 97.5])
    assert got["P"]["ci95_low"] == pytest.approx(low) and got["P"]["ci95_high"] == pytest.approx(high)
    assert got["Q"]["ci95_low"] == 1.0 == got["Q"]["ci95_high"]
    # The draws are fair: each of the five images about as often as any other.
    times = np.bincount([int(hashlib.md5(f"0:{b}:{j}".encode()).hexdigest()[:13], 16) % 5 for b in range(N_BOOT) for j in range(5)])
    assert abs(times / N_BOOT - 1).max() < 0.1


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_exact_quantiles(spark, rounds):
    rng = np.random.default_rng(6)
    data = {
        "normal": rng.normal(size=501),
        "ties": np.r_[np.zeros(300), 1.0, 2.0],
        "far": np.r_[rng.random(50), 1e9],
        "one": np.array([3.0]),
    }
    df = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a], "k string, v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.98, 1.0]
    got = {r["k"]: r["q"] for r in exact_quantiles(df, ["k"], "v", probs, slices=8, rounds=rounds).collect()}
    for k, a in data.items():
        np.testing.assert_allclose(got[k], np.quantile(a, probs), rtol=1e-12)


def test_tile_quantiles(spark):
    rng = np.random.default_rng(7)
    images = {
        "noise": rng.normal(size=(50, 70)),
        "ties": rng.integers(-2, 3, size=(40, 40)).astype(float),
        "narrow": 1.0 + rng.random((30, 30)) * 1e-4,
        "flat": np.full((10, 10), -3.5),
        "dot": np.array([[2.0]]),
    }
    probs = [0.0, 0.01, 0.5, 0.98, 0.99, 1.0]
    got = {r["image_id"]: r["q"] for r in tile_quantiles(float_tiles(spark, images, 16), probs).collect()}
    for name, a in images.items():
        np.testing.assert_allclose(got[name], np.quantile(a.astype(np.float32).astype(float), probs), rtol=1e-12, atol=1e-15)


def test_metrics_on_other_images_draw_apart(spark):
    """Metrics that miss an image draw among the rest; those defined on the same images share draws."""
    inf = float("inf")
    rows = [("P", "a", 1.0, 2.0, inf), ("P", "b", 4.0, 8.0, 5.0), ("P", "c", 9.0, 18.0, 7.0), ("Q", "a", 3.0, 6.0, inf)]
    df = spark.createDataFrame(rows, "patient_id string, image_id string, length double, max_curvature double, tortuosity double")
    got = {(r["patient_id"], r["metric"]): (r["ci95_low"], r["ci95_high"]) for r in summarize_per_patient(df, bootstrap=True).collect()}
    alone = {
        (r["patient_id"], r["metric"]): (r["ci95_low"], r["ci95_high"])
        for m in ("length", "tortuosity", "max_curvature")
        for r in summarize_per_patient(df, metrics=[m], bootstrap=True).collect()
    }
    assert got == alone and len(got) == 6
    assert got["Q", "tortuosity"] == (None, None) and got["P", "max_curvature"][1] == 2 * got["P", "length"][1]
    assert 5.0 <= got["P", "tortuosity"][0] < got["P", "tortuosity"][1] <= 7.0
