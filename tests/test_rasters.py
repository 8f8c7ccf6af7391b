from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from helpers import assemble, bool_tiles, draw, float_tiles, points_df
from pyspark.sql import functions as F

from strandflow import session
from strandflow.functions.arrays import dilate_disk
from strandflow.operators import micrographs as M
from strandflow.operators import patches as P
from strandflow.operators import rasters as R
from strandflow.operators import ridge as G
from strandflow.operators import tiles as T
from strandflow.plans import jobs
from strandflow.plans.catalog import QUERIES
from strandflow.sources.images import png_bytes, read_pictures
from strandflow.sources.mrc import read_mrc, write_mrc

RNG = np.random.default_rng(0)


def chip(spark, a: np.ndarray):
    row = [("i", a.shape[0], a.shape[1], a.ravel().astype(float).tolist())]
    return spark.createDataFrame(row, "image_id string, height int, width int, px array<double>")


def test_tile_round_trip_and_pixels(spark):
    a = RNG.random((70, 45)).astype(np.float32)
    tiles = float_tiles(spark, {"a": a}, 32)
    np.testing.assert_array_equal(assemble(tiles, a.shape), a)
    m = a > 0.7
    px = T.tile_pixels(T.map_tiles(tiles, lambda v, _: (v > 0.7).astype(np.uint8)))
    assert px.count() == m.sum()
    back = T.mask_tiles(px.select("image_id", "y", "x", "height", "width"), tile=32)
    np.testing.assert_array_equal(assemble(back, a.shape, np.uint8) > 0, m)


@pytest.mark.parametrize("border", ["symmetric", "zero"])
def test_halo_equals_padding(spark, border):
    a = RNG.random((70, 45)).astype(np.float32)
    whole = np.pad(a, 20, mode="symmetric" if border == "symmetric" else "constant")
    for r in T.with_halo(float_tiles(spark, {"a": a}, 32), 20, tile=32, border=border).collect():
        w = np.frombuffer(r.pixels, np.float32).reshape(r.h + 40, r.w + 40)
        np.testing.assert_array_equal(w, whole[r.y0 : r.y0 + r.h + 40, r.x0 : r.x0 + r.w + 40])


def test_ridge_map(spark):
    img = np.ones((150, 200))
    line = draw(img.shape, [((20, 40), (180, 110))], 5)
    img[line] = 0
    img += RNG.normal(0, 0.1, img.shape)
    a = assemble(G.ridge_map(float_tiles(spark, {"i": img}, 64), tile=64), img.shape)
    b = assemble(G.ridge_map(float_tiles(spark, {"i": img}, 256)), img.shape)
    np.testing.assert_allclose(a, b, atol=1e-6)
    assert 0 <= a.min() and a.max() == pytest.approx(1, abs=1e-6)
    assert a[draw(img.shape, [((20, 40), (180, 110))], 2)].mean() > 5 * a[~line].mean()


def test_normalize_variants(spark):
    a = RNG.random((40, 40)).astype(np.float32)
    low, high = np.percentile(a, [1, 99])
    got = assemble(G.normalize_tiles(float_tiles(spark, {"a": a}, 16)), a.shape)
    np.testing.assert_allclose(got, np.clip((a - low) / (high - low), 0, 1), atol=1e-6)
    flat = np.full((20, 20), 3.0)
    assert assemble(G.normalize_tiles(float_tiles(spark, {"f": flat}, 16)), flat.shape).max() == 0
    row = chip(spark, a).select(R.normalize_percentile(F.col("px")).alias("n"), R.standardize(F.col("px")).alias("z")).first()
    np.testing.assert_allclose(np.array(row["n"]).reshape(a.shape), np.clip((a - low) / (high - low), 0, 1), atol=1e-6)
    np.testing.assert_allclose(row["z"], ((a - a.mean()) / (a.std() + 1e-9)).ravel(), atol=1e-5)


def test_ignore_mask(spark):
    ridge = RNG.random((60, 60)).astype(np.float32)
    mask = draw(ridge.shape, [((5, 5), (50, 40))], 5)
    got = assemble(
        G.ignore_mask(float_tiles(spark, {"i": ridge}, 32), bool_tiles(spark, {"i": mask}, 32), dilation=3, tile=32),
        ridge.shape,
        np.uint8,
    ) > 0
    want = (ridge > np.quantile(ridge.astype(float), 0.98)) & ~mask
    grown = np.zeros_like(want)
    for y, x in zip(*np.nonzero(want)):
        for dy, dx in R.disk_offsets(3):
            if 0 <= y + dy < 60 and 0 <= x + dx < 60:
                grown[y + dy, x + dx] = True
    np.testing.assert_array_equal(got, grown & ~mask)


def test_lines_and_dilation(spark):
    seg = [("i", 2.4, 3.0, 9.0, 5.0), ("i", 5.5, 5.5, 5.5, 1.0), ("i", -4.0, 8.0, 3.0, 8.0), ("i", 3.0, 3.0, 3.0, 3.0)]
    df = spark.createDataFrame(seg, "image_id string, x0 double, y0 double, x1 double, y1 double")
    df = df.withColumn("height", F.lit(10)).withColumn("width", F.lit(10))
    px = {(r["y"], r["x"]) for r in R.draw_segments(df, ["image_id"]).collect()}
    assert {(3, 2), (5, 9), (8, 0), (8, 3), (3, 3)} <= px
    assert {(y, 6) for y in range(1, 7)} <= px  # 5.5 rounds to even
    assert all(0 <= y < 10 and 0 <= x < 10 for y, x in px)
    one = R.rasterize(df, ["image_id"], width_px=1).count()
    assert one == len(px) and R.rasterize(df, ["image_id"], width_px=7).count() > one
    assert len(R.disk_offsets(3)) == 29


def test_tile_positions(spark):
    df = spark.createDataFrame([(300, 421)], "height int, width int")
    got = {(r["y"], r["x"]) for r in R.tile_positions(df, 128, 32).collect()}
    cover = np.zeros((300, 421), dtype=bool)
    for y, x in got:
        assert y + 128 <= 300 and x + 128 <= 421
        cover[y : y + 128, x : x + 128] = True
    assert cover.all()
    small = spark.createDataFrame([(50, 60)], "height int, width int")
    assert R.tile_positions(small, 128, 32).collect()[0][2:] == (0, 0)
    with pytest.raises(ValueError):
        R.tile_positions(df, 64, 64)


@pytest.mark.parametrize("shape", [(150, 210), (50, 90)])
def test_predict_and_stitch(spark, shape):
    a = np.linspace(0, 1, shape[1])[None, :] * np.ones(shape)
    tiles = float_tiles(spark, {"i": a}, 64)
    cut = P.patches_of(tiles, patch=64, overlap=16, tile=64)
    np.testing.assert_allclose(assemble(P.stitch_patches(cut, patch=64, tile=64), shape), a, atol=1e-5)
    prob = P.predict_tiles(tiles, lambda: (lambda x: 1 - x), patch=64, overlap=16, tile=64)
    low, high = np.percentile(a, [1, 99])
    np.testing.assert_allclose(assemble(prob, shape), 1 - np.clip((a - low) / (high - low), 0, 1), atol=1e-4)


def test_training_patches(spark):
    mask = draw((150, 150), [((10, 10), (60, 20))], 5)
    image = RNG.random(mask.shape).astype(np.float32)
    ignore = RNG.random(mask.shape) > 0.9
    args = (float_tiles(spark, {"i": image}, 64), bool_tiles(spark, {"i": mask}, 64), bool_tiles(spark, {"i": ignore}, 64))
    rows = P.training_patches(*args, patch=64, overlap=16, tile=64).collect()
    want = {(y, x) for y in P._starts(150, 64, 16) for x in P._starts(150, 64, 16) if mask[y : y + 64, x : x + 64].sum() >= 20}
    assert {(r.y, r.x) for r in rows} == want
    for r in rows:
        w = np.frombuffer(r.weight, np.uint8).reshape(64, 64)
        np.testing.assert_array_equal(w, 1 - ignore[r.y : r.y + 64, r.x : r.x + 64])
    turned = {(r.y, r.x): r for r in P.training_patches(*args, patch=64, overlap=16, tile=64, seed=3).collect()}
    for r in rows:
        t = turned[r.y, r.x]
        a, b = (np.frombuffer(q.pixels, np.float32).reshape(64, 64) for q in (r, t))
        am, bm = (np.frombuffer(q["mask"], np.uint8).reshape(64, 64) for q in (r, t))
        forms = [(f(np.rot90(a, k)), f(np.rot90(am, k))) for k in range(4) for f in (lambda v: v, np.fliplr)]
        assert any(np.array_equal(x, b) and np.array_equal(m, bm) for x, m in forms)


def test_dice_bce(spark):
    x, t, w = RNG.normal(size=200) * 3, (RNG.random(200) < 0.3) * 1.0, (RNG.random(200) < 0.8) * 1.0
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(x, t, w)], "x double, t double, w double")
    got = df.agg(P.dice_bce(F.col("x"), F.col("t"), F.col("w")).alias("l")).first()["l"]
    p = 1 / (1 + np.exp(-x))
    bce = -(10 * t * np.log(p) + (1 - t) * np.log(1 - p))
    want = (bce * w).sum() / w.sum() + 1 - (2 * (p * t * w).sum() + 1e-6) / ((p * w).sum() + (t * w).sum() + 1e-6)
    assert got == pytest.approx(want)


def streaks(seed: int, shape: tuple[int, int] = (320, 448)) -> np.ndarray:
    """Grey field, a dozen dark strokes, and a dark corner shared by all fields."""
    rng = np.random.default_rng(seed)
    img = np.full(shape, 0.6)
    for _ in range(12):
        a, turn = rng.uniform((0, 0), shape[::-1]), rng.uniform(0, 2 * np.pi)
        b = a + 130 * np.array([np.cos(turn), np.sin(turn)])
        img[draw(shape, [(tuple(a), tuple(b))], 3)] = 0.25
    img[np.add.outer(np.arange(shape[0]), np.arange(shape[1])) > 0.82 * sum(shape)] = 0.05
    return img


def test_micrograph_matching(spark, tmp_path):
    shots = {f"s{k}": streaks(k) for k in range(4)}
    (tmp_path / "shots").mkdir()
    for k, v in shots.items():
        (tmp_path / "shots" / f"{k}.png").write_bytes(png_bytes(255 * v))
    noisy = np.kron(shots["s2"], np.ones((4, 4)))
    write_mrc(str(tmp_path / "mic.mrc"), noisy + RNG.normal(0, 0.1, noisy.shape), 1.5)
    m = M.match_micrographs(read_mrc(spark, str(tmp_path)), read_pictures(spark, str(tmp_path / "shots")))
    r = m.first()
    assert r["best_id"] == "s2" and r["matched"] and r["best_score"] > 0.85
    assert r["best_score"] - r["runner_up_score"] > 0.2
    assert r["scale"] == 4.0 and r["screenshot_pixel_size_a"] == pytest.approx(6.0)
    assert M.mapping_rows(m).first()["image_id"] == "s2"
    assert M.distinct_pixel_sizes(m).count() == 1


def test_top_two_in_turns(spark):
    a, b = RNG.normal(size=(7, 30)), RNG.normal(size=(11, 30))
    images = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "image_id long, px array<double>")
    shots = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "shot_id long, px array<double>")
    whole = {r["image_id"]: r for r in M.top_two(images, shots).collect()}
    split = {r["image_id"]: r for r in M.top_two(images, shots, broadcast_bytes=600).collect()}
    corr = np.corrcoef(a, b)[:7, 7:]
    for i in range(7):
        order = np.argsort(-corr[i])
        assert whole[i]["best_id"] == order[0] == split[i]["best_id"]
        assert whole[i]["runner_up_id"] == order[1] == split[i]["runner_up_id"]
        assert whole[i]["best_score"] == pytest.approx(corr[i].max(), abs=1e-6)


def test_far_vertices_are_clipped_before_pixels_are_made(spark):
    ends = [(-7.0, 3.0, 12.0, 5.0), (4.0, 30.0, 2.0, -9.0), (50.0, 50.0, 60.0, 60.0), (3.0, 4.0, 3.0, 4.0), (12.0, -3.0, -6.0, 14.0)]
    df = spark.createDataFrame([(i, 10, 8, *map(float, e)) for i, e in enumerate(ends)], "k int, height int, width int, x0 double, y0 double, x1 double, y1 double")
    got = {(r["k"], r["y"], r["x"]) for r in R.draw_segments(df, ["k"]).collect()}
    want = set()
    for k, (x0, y0, x1, y1) in enumerate(ends):
        n = int(max(abs(x1 - x0), abs(y1 - y0)))
        m = int(min(abs(x1 - x0), abs(y1 - y0)))
        for t in range(n + 1):
            side = (2 * t * m + n) // max(2 * n, 1) if n else 0
            dx, dy = (side, t) if abs(y1 - y0) > abs(x1 - x0) else (t, side)
            y, x = int(y0 + (dy if y1 >= y0 else -dy)), int(x0 + (dx if x1 >= x0 else -dx))
            if 0 <= y < 10 and 0 <= x < 8:
                want.add((k, y, x))
    assert got == want and want
    far = spark.createDataFrame([(0, 10, 8, 2.0, 5.0, 1e9, 5.0)], df.schema)
    assert {(r["y"], r["x"]) for r in R.draw_segments(far, ["k"]).collect()} == {(5, x) for x in range(2, 8)}


def test_blocks_score_as_pairs_do(spark):
    a, b = RNG.uniform(size=(23, 40)), RNG.uniform(size=(31, 40))
    b[3], b[4] = 0.5, b[5]
    keep = RNG.uniform(size=a.shape) < 0.5
    keep[2] = False
    want = np.zeros((23, 31))
    for i in range(23):
        for j in range(31):
            x, y = a[i][keep[i]], b[j][keep[i]]
            if len(x):
                want[i, j] = ((x - x.mean()) / (x.std() + 1e-9) * (y - y.mean()) / (y.std() + 1e-9)).mean()
    assert np.allclose(M._block_scores(a, b, keep), want, atol=1e-7)
    images = spark.createDataFrame([(f"i{i}", v.tolist(), k.tolist()) for i, (v, k) in enumerate(zip(a, keep))], "image_id string, px array<double>, m array<boolean>")
    shots = spark.createDataFrame([(f"s{j:02d}", v.tolist()) for j, v in enumerate(b)], "shot_id string, px array<double>")
    for block in (400, 3000, 1 << 20):
        for r in M.top_two(images, shots, mask="m", block_bytes=block).collect():
            i = int(r["image_id"][1:])
            order = sorted(range(31), key=lambda j: (-round(want[i, j], 9), -j))
            assert [r["best_id"], r["runner_up_id"]] == [f"s{j:02d}" for j in order[:2]]
            assert r["best_score"] == pytest.approx(want[i, order[0]], abs=1e-6)
    assert M.top_two(images, shots.limit(0), mask="m").count() == 0 == M.top_two(images.limit(0), shots).count()


def test_carbon_needs_masking():
    a, b = M._normalized(streaks(1)), M._normalized(streaks(2))
    ice = M._blurred(M._normalized(a), M.CARBON_SIGMA) >= M.CARBON_LEVEL
    assert not ice[-10, -10] and ice[160, 200]
    with_carbon = M._masked_scores(a.ravel(), b.reshape(1, -1), None)[0]
    without = M._masked_scores(a.ravel(), b.reshape(1, -1), ice.ravel())[0]
    assert with_carbon > 0.6 and without < 0.5 and with_carbon - without > 0.3


def test_resize_keeps_flat_images():
    for shape in ((10, 7), (40, 30), (20, 15)):
        np.testing.assert_allclose(M.resize_bilinear(np.full((20, 15), 2.5), *shape), 2.5)
    a = RNG.random((12, 12))
    np.testing.assert_allclose(M.resize_bilinear(a, 12, 12), a)


def test_mask_scores(spark):
    a, b = np.zeros((10, 10), bool), np.zeros((10, 10), bool)
    a[1:5, 1:5] = b[3:7, 1:5] = True
    none = np.zeros((10, 10), bool)
    imgs = {"x": a, "e": none}
    got = {
        r["image_id"]: r
        for r in jobs.mask_scores(
            bool_tiles(spark, imgs, 4), bool_tiles(spark, {"x": b, "e": none}, 4), bool_tiles(spark, {"x": none, "e": none}, 4)
        ).collect()
    }
    assert got["x"]["dice_labelled"] == 0.5 and got["x"]["iou"] == pytest.approx(8 / 24)
    assert got["e"]["dice_all_pixels"] == 1.0 == got["e"]["iou"]
    assert got["x"]["predicted_fraction"] == 0.16


def test_burned_in_overlay(spark):
    img = RNG.random((80, 80)) * 0.3
    line = draw(img.shape, [((10, 10), (70, 60))], 3)
    img[line] = 1.0
    img[5, 70] = img[6, 70] = 1.0
    got = jobs.burned_in_mask(float_tiles(spark, {"i": img}, 32), tile=32).collect()
    assert {(r["y"], r["x"]) for r in got} == set(zip(*map(lambda v: v.tolist(), np.nonzero(line))))


def test_label_building(spark):
    img = np.ones((120, 160))
    img[draw(img.shape, [((10, 60), (150, 60))], 5)] = 0
    img[draw(img.shape, [((10, 20), (150, 20))], 5)] = 0
    img += RNG.normal(0, 0.05, img.shape)
    tiles = float_tiles(spark, {"img": np.clip(img, 0, 1)}, 128)
    mask, ignore, lines = jobs.build_labels(tiles, points_df(spark, {"a": [(20, 66), (140, 66)]}), max_shift=12.0, tile=128)
    m, g = assemble(mask, img.shape, np.uint8) > 0, assemble(ignore, img.shape, np.uint8) > 0
    assert m[58:63, 40:120].mean() > 0.95 and not m[15:25].any()
    assert g[18:23, 40:120].mean() > 0.5 and not (m & g).any()
    y = [r["y"] for r in lines.collect()]
    assert abs(np.median(y) - 60) < 1.5


def test_scores_are_held_a_few_rows_at_a_time():
    a, b = RNG.random((3000, 16)), RNG.random((3000, 16))
    tracemalloc.start()
    row, shot, score = M._best_two(a, b, a > 0.3, score_bytes=1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 << 20  # all scores are 72 MB
    want = M._block_scores(a, b, a > 0.3)
    np.testing.assert_allclose(score.reshape(-1, 2), -np.sort(-want, axis=1)[:, :2], atol=1e-9)
    assert (row == np.repeat(np.arange(3000), 2)).all() and len(shot) == 6000


@pytest.mark.parametrize("mask", [None, "m"])
def test_equal_screenshots_tie_wherever_they_lie(spark, mask):
    # Three copies of each screenshot; with a mask, all nine pixels outside it differ.
    px = [[round(float(v), 1) for v in RNG.random(25)] for _ in range(40)]
    ice = [k < 16 for k in range(25)]
    rows = [(k + 40 * c, [v + (c if mask and not i else 0) for v, i in zip(p, ice, strict=True)]) for c in range(3) for k, p in enumerate(px)]
    shots = spark.createDataFrame(rows, "shot_id long, px array<double>")
    images = spark.createDataFrame([(k, p, ice) for k, p in enumerate(px)], "image_id long, px array<double>, m array<boolean>")
    for size in (1 << 20, 2000, 700):
        for r in M.top_two(images, shots, mask=mask, block_bytes=size).collect():
            assert (r.best_id, r.runner_up_id) == (r.image_id + 80, r.image_id + 40)
            assert r.best_score == r.runner_up_score


@pytest.mark.parametrize("name", ["stitch_tiles", "tile_mask_scores"])
def test_rasters_are_not_broadcast(spark, name):
    """The files read are small, the rasters drawn from them are not."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan.split("== Physical Plan ==")[1]


def test_pieces_of_a_tile_meet_as_they_come(spark):
    many = {f"i{k:03}": RNG.random((5, 9)).astype(np.float32) for k in range(300)}
    padded = T.with_halo(float_tiles(spark, many, 4), 2, tile=4, border="zero")
    assert "FlatMapGroups" not in padded._jdf.queryExecution().toString()
    rows = padded.collect()
    assert len(rows) == len({(r.image_id, r.ty, r.tx) for r in rows}) == 300 * 2 * 3
    for r in rows:
        w = np.frombuffer(r.pixels, np.float32).reshape(r.h + 4, r.w + 4)
        np.testing.assert_array_equal(w, np.pad(many[r.image_id], 2)[r.y0 : r.y0 + r.h + 4, r.x0 : r.x0 + r.w + 4])


def test_ridges_take_one_python_worker_a_stage(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    plans, checkpoint = [], DataFrame.checkpoint

    def kept(df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", kept)
    tiles = session.cut_lineage(float_tiles(spark, {"a": RNG.random((40, 50)).astype(np.float32)}, 32))
    G.ridge_map(tiles, sigmas=(1.0,), tile=32)
    # The range; scaling with its strips; denoising with its strips; the padded tiles.
    assert plans[1].count("MapInArrow") == 4


def test_drawn_curves_are_dealt_by_their_pixels(spark, monkeypatch):
    monkeypatch.setattr(session, "ROWS_A_TASK", 25_000)
    pixels = QUERIES["rasterize"](spark, "/root/testdata/sf0.001")
    # 500 curves of a thousand pixels each: 20 parts instead of the session's 4.
    assert pixels.rdd.getNumPartitions() == 20
    assert pixels.count() == pixels.distinct().count()


def test_padded_tiles_are_worked_on_where_they_are_put_together(spark):
    a = RNG.random((40, 50)) > 0.97
    tiles = T.map_tiles(float_tiles(spark, {"i": a.astype(np.float32)}, 16), lambda v, _: (v > 0).astype(np.uint8)).localCheckpoint()
    grown = T.dilate_tiles(tiles, 2, tile=16)
    # The strips that tiles send, and the tiles put together and grown.
    assert grown._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 2
    np.testing.assert_array_equal(assemble(grown, a.shape, np.uint8) > 0, dilate_disk(a, 2))
