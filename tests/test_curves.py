from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import points_df, polylines
from pyspark.sql import functions as F

from strandflow import session
from strandflow.operators import curves as C
from strandflow.plans import standins


def metrics(df, layout=C.Layout(), **kw):
    return {r["filament_id"]: r for r in C.curve_metrics(df, layout, **kw).collect()}


def brute_metrics(p: np.ndarray) -> dict:
    p = np.asarray(p, dtype=float)
    p = p[np.r_[True, (np.diff(p, axis=0) != 0).any(axis=1)]]
    d = np.diff(p, axis=0)
    ds = np.hypot(*d.T)
    turn = np.angle(np.exp(1j * np.diff(np.arctan2(d[:, 1], d[:, 0]))))
    curv = np.abs(turn) / ((ds[1:] + ds[:-1]) / 2)
    chord = np.hypot(*(p[-1] - p[0]))
    return {
        "length": ds.sum(),
        "tortuosity": ds.sum() / chord if chord else math.inf,
        "max_curvature": curv.max() if len(curv) else 0.0,
        "mean_abs_curvature": curv.mean() if len(curv) else 0.0,
        "total_abs_turning": np.abs(turn).sum(),
        "n_points": len(p),
    }


def arc(r: float, end: float = math.pi / 2, step: float = 0.02) -> np.ndarray:
    phi = np.arange(0, end, step)
    return np.column_stack([r * np.cos(phi), r * np.sin(phi)])


def test_known_shapes(spark):
    shapes = {
        "line": np.column_stack([np.linspace(0, 100, 50), np.zeros(50)]),
        "corner": [(0, 0), (10, 0), (10, 10)],
        "circle": arc(50),
        "repeats": [(0, 0), (0, 0), (5, 0), (5, 0), (10, 0)],
        "closed": [(0, 0), (4, 0), (4, 3), (0, 0)],
        "two": [(0, 0), (3, 4)],
        "one": [(1, 1)],
        "collapsed": [(2, 2), (2, 2)],
    }
    m = metrics(points_df(spark, shapes))
    assert set(m) == set(shapes) - {"one", "collapsed"}
    assert m["line"]["length"] == pytest.approx(100) and m["line"]["tortuosity"] == pytest.approx(1)
    assert m["line"]["max_curvature"] == pytest.approx(0, abs=1e-12)
    assert m["corner"]["total_abs_turning"] == pytest.approx(math.pi / 2)
    assert m["corner"]["tortuosity"] == pytest.approx(20 / math.sqrt(200))
    assert m["circle"]["mean_abs_curvature"] == pytest.approx(1 / 50, rel=0.02)
    assert m["circle"]["max_curvature"] == pytest.approx(1 / 50, rel=0.05)
    assert m["repeats"]["length"] == 10 and m["repeats"]["n_points"] == 3
    assert m["closed"]["tortuosity"] == math.inf
    assert (m["two"]["total_abs_turning"], m["two"]["max_curvature"], m["two"]["length"]) == (0.0, 0.0, 5.0)
    assert m["circle"]["local_dir_change_per_length"] == m["circle"]["mean_abs_curvature"]


def test_pixel_size(spark):
    df = points_df(spark, {"arc": arc(50)})
    one, two = metrics(df)["arc"], metrics(df, pixel_size=2.0)["arc"]
    assert two["length"] == pytest.approx(2 * one["length"])
    assert two["tortuosity"] == pytest.approx(one["tortuosity"])
    assert two["mean_abs_curvature"] == pytest.approx(one["mean_abs_curvature"] / 2)
    assert two["total_abs_turning"] == pytest.approx(one["total_abs_turning"])


@pytest.mark.parametrize("rows", [1, 2, 4, 1024])
def test_blocks_do_not_change_metrics(spark, rows):
    rng = np.random.default_rng(1)
    shapes = {f"r{k}": np.round(rng.normal(size=(k, 2)) * 2) for k in (3, 7, 16, 50)}
    shapes["still"] = np.repeat([(0, 0), (1, 0), (1, 1), (5, 1)], 5, axis=0)
    df = points_df(spark, shapes).withColumn("block", C.block_of(F.col("seq"), rows))
    m = metrics(df)
    for name, p in shapes.items():
        want = brute_metrics(p)
        for key, value in want.items():
            assert m[name][key] == pytest.approx(value), (name, key)


def test_reversal_and_motion(spark):
    rng = np.random.default_rng(2)
    p = np.cumsum(rng.normal(size=(40, 2)), axis=0)
    rot = np.array([[0.6, -0.8], [0.8, 0.6]])
    m = metrics(points_df(spark, {"a": p, "b": p[::-1], "c": p @ rot.T + 7}))
    for key in ("length", "tortuosity", "max_curvature", "total_abs_turning"):
        assert m["b"][key] == pytest.approx(m["a"][key])
        assert m["c"][key] == pytest.approx(m["a"][key])


def brute_resample(p: np.ndarray, step: float) -> np.ndarray:
    s = np.r_[0, np.cumsum(np.hypot(*np.diff(p, axis=0).T))]
    if s[-1] <= 0:
        return p[:1]
    at = np.linspace(0, s[-1], max(math.ceil(s[-1] / step) + 1, 2))
    return np.column_stack([np.interp(at, s, p[:, 0]), np.interp(at, s, p[:, 1])])


def brute_smooth(p: np.ndarray, window: int) -> np.ndarray:
    if window < 3 or len(p) <= window:
        return p
    window += window % 2 == 0
    half = window // 2
    out = np.array(
        [p[np.clip(np.arange(i - half, i + half + 1), 0, len(p) - 1)].mean(axis=0) for i in range(len(p))]
    )
    out[0], out[-1] = p[0], p[-1]
    return out


def test_resample_and_smooth_match_brute_force(spark):
    rng = np.random.default_rng(3)
    shapes = {f"w{k}": np.cumsum(rng.normal(size=(k, 2)) * 2, axis=0) for k in (2, 5, 23)}
    shapes["dup"] = np.array([(0, 0), (0, 0), (3, 0), (3, 0), (3, 4), (3, 4.0)])
    shapes["short"] = np.array([(0, 0), (0.2, 0)])
    shapes["point"] = np.array([(1.0, 1.0)])
    shapes["still"] = np.array([(1.0, 1.0), (1.0, 1.0)])
    df = points_df(spark, shapes).withColumn("block", C.block_of(F.col("seq"), 4))
    for step in (1.0, 0.37):
        got = polylines(C.resample(df, step=step), "filament_id")
        for name, p in shapes.items():
            np.testing.assert_allclose(got["img", name], brute_resample(p, step), atol=1e-9)
    even = {k: brute_resample(p, 1.0) for k, p in shapes.items()}
    long = points_df(spark, even)
    for window in (1, 3, 4, 5, 9):
        for rows in (16, 65536):
            got = polylines(C.smooth(long, window=window, block_rows=rows), "filament_id")
            for name, p in even.items():
                np.testing.assert_allclose(got["img", name], brute_smooth(p, window), atol=1e-9, err_msg=f"{name} {window} {rows}")


@pytest.mark.parametrize("n", range(12, 22))
def test_smooth_near_block_borders(spark, n):
    p = np.column_stack([np.arange(n), np.arange(n) ** 2]).astype(float)
    got = polylines(C.smooth(points_df(spark, {"a": p}), window=5, block_rows=8), "filament_id")
    np.testing.assert_allclose(got["img", "a"], brute_smooth(p, 5))


def test_smooth_expected_values(spark):
    p = np.column_stack([np.arange(10), np.zeros(10)])
    got = polylines(C.smooth(points_df(spark, {"a": p}), window=5), "filament_id")["img", "a"][:, 0]
    np.testing.assert_allclose(got, [0, 1.2, 2, 3, 4, 5, 6, 7, 7.8, 9])


def test_normals_and_ends(spark):
    p = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    df = points_df(spark, {"a": p})
    n = [(r["nx"], r["ny"]) for r in C.unit_normals(df).orderBy("i").collect()]
    g = np.gradient(np.array(p, dtype=float), axis=0)
    g /= np.hypot(*g.T)[:, None]
    np.testing.assert_allclose(n, np.column_stack([-g[:, 1], g[:, 0]]), atol=1e-12)
    ends = {r["at_start"]: r for r in C.endpoints(df, span=1).collect()}
    assert (ends[True]["dx"], ends[True]["dy"]) == (-1.0, 0.0)
    assert (ends[False]["x"], ends[False]["dy"]) == (2.0, 1.0)


def test_drop_repeats(spark):
    df = points_df(spark, {"a": [(0, 0), (0, 0), (1, 0), (0, 0)]}).withColumn("block", C.block_of(F.col("seq"), 1))
    assert C.drop_repeats(df).count() == 3


def test_one_exchange_per_level(spark):
    df = points_df(spark, {"a": arc(50)})
    plan = C.curve_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lines_of_orders_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 500)
    lines = standins.curves_orders(spark, "/root/testdata/sf0.001")
    sizes = lines.groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= 10 and max(r["count"] for r in sizes) < 1000
    # Curves are measured where their lines lie: no further exchange of vertices.
    plan = C.curve_metrics(lines, standins.V2)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_id" not in plan


def test_samples_are_dealt_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(C, "SAMPLES_A_TASK", 50)
    v = points_df(spark, {str(k): [(0, k), (99, k)] for k in range(20)})
    rows = C.count_samples(v)
    assert rows == 20 * 100
    done = C.finish(v, rows=rows)
    assert done.rdd.getNumPartitions() == 40
    plain = {(r.filament_id, r.seq): (r.x, r.y) for r in C.finish(v).collect()}
    assert {(r.filament_id, r.seq): (r.x, r.y) for r in done.collect()} == plain and len(plain) == 2000
