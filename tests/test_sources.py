from __future__ import annotations

import io
import json
import os
import struct
import zipfile
from datetime import datetime

import numpy as np
import pytest
from helpers import assemble, draw, points_df, polylines
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from strandflow.cli import main as cli
from strandflow.config import Config
from strandflow.plans import jobs
from strandflow.schema import METRICS, PER_IMAGE
from strandflow.sources import commit, sinks
from strandflow.sources.decks import read_deck
from strandflow.sources.images import picture_size, png_bytes, read_grayscale, read_pictures
from strandflow.sources.mrc import decode_mrc, image_table, parse_header, read_mrc, read_mrc_headers, write_mrc
from strandflow.sources.traces import labelled_images, parse_roi, read_traces
from strandflow.streaming.append import measure_new_traces

RNG = np.random.default_rng(0)


def test_mrc_round_trip(spark, tmp_path):
    a = RNG.normal(size=(300, 410)).astype(np.float32)
    write_mrc(str(tmp_path / "m1.mrc"), a, 3.3)
    write_mrc(str(tmp_path / "m2.mrc"), a[:50, :60], 0.0)
    tiles = read_mrc(spark, str(tmp_path), tile=128)
    np.testing.assert_array_equal(assemble(tiles.filter("image_id = 'm1'"), a.shape), a)
    info = {r["image_id"]: r for r in image_table(tiles).collect()}
    heads = {r["image_id"]: r for r in read_mrc_headers(spark, str(tmp_path)).collect()}
    assert {k: r.asDict() for k, r in heads.items()} == {k: r.asDict() for k, r in info.items()}
    assert info["m1"]["pixel_size_a"] == pytest.approx(3.3, rel=1e-6) and info["m2"]["pixel_size_a"] == 1.0
    assert info["m1"]["pixel_size_nm"] == pytest.approx(0.33, rel=1e-6)
    over = image_table(read_mrc(spark, str(tmp_path / "m1.mrc"), pixel_size_a=7.0)).first()
    assert over["pixel_size_a"] == 7.0
    binary = decode_mrc(spark.read.format("binaryFile").load(str(tmp_path / "m1.mrc")), tile=128)
    np.testing.assert_array_equal(assemble(binary, a.shape), a)


def test_mrc_stack_types_and_errors(spark, tmp_path):
    stack = RNG.integers(-500, 500, size=(3, 20, 30)).astype(">i2")
    head = bytearray(1024)
    struct.pack_into(">4i", head, 0, 30, 20, 3, 1)
    struct.pack_into(">i", head, 92, 64)
    head[212:214] = b"\x11\x11"
    path = tmp_path / "s.mrc"
    path.write_bytes(bytes(head) + bytes(64) + stack.tobytes())
    got = assemble(read_mrc(spark, str(path), frame=2), (20, 30))
    np.testing.assert_array_equal(got, stack[2].astype(np.float32))
    with pytest.raises(Exception, match="out of range"):
        read_mrc(spark, str(path), frame=3).count()
    struct.pack_into(">i", head, 88, 401)
    with pytest.raises(ValueError):
        parse_header(bytes(head))


def test_csv_traces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Filament_ID,X,Y,note\n0000,1,2,p\n0000,3,4,q\nlone,0,0,r\n,9,9,s\n0001,5,6,t\n0000,7,8,u\n0001,0,1,v\n")
    t = read_traces(spark, str(tmp_path / "a.csv"))
    p = polylines(t, "filament_id")
    assert set(p) == {("a", "0000"), ("a", "0001")}
    np.testing.assert_array_equal(p["a", "0000"], [(1, 2), (3, 4), (7, 8)])
    (tmp_path / "b.csv").write_text("id,x,y\n1,2,3\n")
    with pytest.raises(ValueError, match="columns"):
        read_traces(spark, str(tmp_path / "b.csv"))
    with pytest.raises(ValueError, match="no known suffix"):
        read_traces(spark, "curves.txt")
    with pytest.raises(ValueError, match="neither csv"):
        read_traces(spark, "curves.csv", source="other")


def test_large_csv_keeps_file_order_over_splits(spark, tmp_path):
    n = 3000
    (tmp_path / "long.csv").write_text("filament_id,x,y\n" + "".join(f"f{k % 2},{k},{k * k % 7}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        p = polylines(read_traces(spark, str(tmp_path / "long.csv")), "filament_id")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    np.testing.assert_array_equal(p["long", "f0"][:, 0], np.arange(0, n, 2))


def roi(points, *, name="", sub_pixel=False, shape=5) -> bytes:
    n = len(points)
    head = bytearray(64)
    head[:4] = b"Iout"
    struct.pack_into(">hB", head, 4, 227, shape)
    left, top = (int(min(p[i] for p in points)) for i in (0, 1))
    struct.pack_into(">4h", head, 8, top, left, top + 9, left + 9)
    struct.pack_into(">H", head, 16, n)
    body = b"".join(struct.pack(f">{n}h", *[int(p[i]) - o for p in points]) for i, o in ((0, left), (1, top)))
    if sub_pixel:
        struct.pack_into(">h", head, 50, 128)
        body += b"".join(struct.pack(f">{n}f", *[p[i] for p in points]) for i in (0, 1))
    second = bytearray(64)
    at = 64 + len(body) + 64
    struct.pack_into(">i", head, 60, 64 + len(body))
    struct.pack_into(">2i", second, 16, at if name else 0, len(name))
    return bytes(head) + body + bytes(second) + name.encode("utf-16-be")


def test_imagej(spark, tmp_path):
    whole, part = [(10, 20), (30, 40), (50, 20)], [(1.5, 2.25), (3.5, 4.75)]
    assert parse_roi(roi(whole, name="fib A")) == ("fib A", [(float(x), float(y)) for x, y in whole])
    assert parse_roi(roi(part, sub_pixel=True))[1] == part
    (tmp_path / "one.roi").write_bytes(roi(whole, name="fib A"))
    with zipfile.ZipFile(tmp_path / "set.zip", "w") as z:
        z.writestr("a.roi", roi(part, sub_pixel=True))
        z.writestr("dot.roi", roi(part[:1], shape=10))
        z.writestr("b.roi", roi(whole, name="named"))
    assert set(polylines(read_traces(spark, str(tmp_path / "one.roi")), "filament_id")) == {("one", "fib A")}
    got = polylines(read_traces(spark, str(tmp_path / "set.zip")), "filament_id")
    assert set(got) == {("set", "f000"), ("set", "named")}
    with zipfile.ZipFile(tmp_path / "none.zip", "w") as z:
        z.writestr("dot.roi", roi(part[:1], shape=10))
    with pytest.raises(PythonException, match="no curve with two"):
        read_traces(spark, str(tmp_path / "none.zip")).count()


def boxed(shape, box, *, sub_pixel=None, path=()) -> bytes:
    """A ROI kept as a box (top, left, bottom, right), or as a composite's path."""
    head = bytearray(64)
    head[:4] = b"Iout"
    struct.pack_into(">hB", head, 4, 227, shape)
    struct.pack_into(">4h", head, 8, *box)
    if sub_pixel:
        struct.pack_into(">4f", head, 18, *sub_pixel)
        struct.pack_into(">h", head, 50, 128)
    struct.pack_into(">i", head, 36, len(path))
    return bytes(head) + struct.pack(f">{len(path)}f", *path)


def test_roi_shapes_without_vertices():
    square = [(3, 2), (3, 12), (23, 12), (23, 2), (3, 2)]
    assert parse_roi(boxed(1, (2, 3, 12, 23)))[1] == square
    assert parse_roi(boxed(1, (0, 0, 0, 0), sub_pixel=(3.5, 2.5, 20.0, 10.0)))[1][2] == (23.5, 12.5)
    oval = np.array(parse_roi(boxed(2, (2, 3, 12, 23)))[1])
    assert len(oval) == 33 and (oval[0] == oval[-1]).all()
    assert np.allclose((((oval - [13, 7]) / [10, 5]) ** 2).sum(axis=1), 1)
    # Two parts: a triangle that is closed, and one of straight and curved pieces, which has more vertices.
    path = [0, 1, 1, 1, 5, 1, 1, 1, 5, 4, 0, 0, 0, 1, 10, 0, 2, 20, 0, 20, 10, 3, 20, 20, 10, 20, 0, 20]
    got = np.array(parse_roi(boxed(9, (0, 0, 20, 20), path=path))[1])
    assert len(got) == 2 + 24 + 24 and got[:2].tolist() == [[0, 0], [10, 0]]
    assert got[13].tolist() == [17.5, 2.5] and got[25].tolist() == [20, 10] and got[-1].tolist() == [0, 20]
    assert parse_roi(boxed(9, (0, 0, 9, 9), path=[0, 1, 1, 1, 5, 1, 1, 1, 5, 4]))[1] == [(1, 1), (5, 1), (1, 5), (1, 1)]
    with pytest.raises(ValueError, match="path"):
        parse_roi(boxed(9, (0, 0, 9, 9), path=[0, 1, 1, 7, 3]))


def test_rois_of_one_name_stay_apart(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        for i, (name, y) in enumerate([("same", 0), ("same", 100), ("", 5), ("f002", 7), ("same-001", 9)]):
            z.writestr(f"{i}.roi", roi([(0, y), (10, y)], name=name))
    got = polylines(read_traces(spark, str(tmp_path / "two.zip")), "filament_id")
    assert len(got) == 5 and all(len(p) == 2 and np.hypot(*(p[1] - p[0])) == 10 for p in got.values())
    assert ("two", "same") in got and ("two", "f002") in got and ("two", "same-001") in got


def test_settings_are_checked(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("pixel_size_a: 2\nother_program: {a: 1}\ndetect: {sigmas: [1, 2]}\ntrace:\n")
    cfg = Config.from_yaml(f)
    assert cfg.pixel_size_a == 2 and cfg.detect.sigmas == [1, 2] and cfg.trace == Config().trace
    for bad, said in (("trace: {smooth_window: 2.5}", "smooth_window"), ("detect: {nothing: 1}", "nothing"), ("bootstrap_ci: 1", "bootstrap_ci"), ("detect: {sigmas: [a]}", "sigmas")):
        f.write_text(bad)
        with pytest.raises((TypeError, ValueError), match=said):
            Config.from_yaml(f)


def test_pictures(spark, tmp_path):
    grey = RNG.integers(0, 256, size=(40, 70)).astype(np.uint8)
    colour = RNG.integers(0, 256, size=(30, 20, 3)).astype(np.uint8)
    (tmp_path / "g.png").write_bytes(png_bytes(grey))
    (tmp_path / "c.png").write_bytes(png_bytes(colour))
    tiles = read_pictures(spark, str(tmp_path), tile=32)
    np.testing.assert_array_equal(assemble(tiles.filter("image_id = 'g'"), grey.shape), grey)
    r, g, b = (colour[:, :, k].astype(int) for k in range(3))
    np.testing.assert_array_equal(
        assemble(tiles.filter("image_id = 'c'"), (30, 20)), (19595 * r + 38470 * g + 7471 * b + 32768) >> 16
    )
    norm = assemble(read_grayscale(spark, str(tmp_path), tile=32).filter("image_id = 'g'"), grey.shape)
    assert norm.min() == 0 and norm.max() == 1
    assert picture_size(png_bytes(grey)) == (70, 40)
    images = tiles.select("image_id").distinct()
    assert labelled_images(images, points_df(spark, {"a": [(0, 0)]}, "g")).count() == 1


A = "http://schemas.openxmlformats.org/drawingml/2006/main"
P = "http://schemas.openxmlformats.org/presentationml/2006/main"
BOX = '<a:xfrm><a:off x="{}" y="{}"/><a:ext cx="{}" cy="{}"/></a:xfrm>'


def deck(path, shapes: str, pictures: int = 1) -> None:
    pic = f"<p:pic><p:spPr>{BOX.format(1000, 2000, 4000, 2000)}</p:spPr></p:pic>" * pictures
    slide = f'<p:sld xmlns:a="{A}" xmlns:p="{P}">{pic}{shapes}</p:sld>'
    rel = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Type="x/image" Target="../media/i.png"/></Relationships>'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rel)
        z.writestr("ppt/media/i.png", png_bytes(np.zeros((200, 400), np.uint8)))


def freeform(box, commands: str, w=100, h=100) -> str:
    return f'<p:sp><p:spPr>{BOX.format(*box)}<a:custGeom><a:pathLst><a:path w="{w}" h="{h}">{commands}</a:path></a:pathLst></a:custGeom></p:spPr></p:sp>'


def pts(*points) -> str:
    return "".join(f'<a:pt x="{x}" y="{y}"/>' for x, y in points)


def test_deck(spark, tmp_path):
    curve = f"<a:moveTo>{pts((0, 0))}</a:moveTo><a:cubicBezTo>{pts((0, 50), (50, 100), (100, 100))}</a:cubicBezTo><a:lnTo>{pts((100, 0))}</a:lnTo>"
    line = f"<a:moveTo>{pts((0, 0))}</a:moveTo><a:lnTo>{pts((100, 100))}</a:lnTo>"
    label = f"<p:sp><p:spPr>{BOX.format(1100, 2100, 10, 10)}</p:spPr><p:txBody><a:t>7</a:t></p:txBody></p:sp>"
    deck(tmp_path / "d.pptx", freeform((1000, 2000, 1000, 1000), curve) + freeform((4000, 3000, 500, 500), line) + label)
    pictures, traces, labels = read_deck(spark, str(tmp_path / "d.pptx"))
    p = polylines(traces, "filament_id")
    c = p["d_slide01", "d_slide01_00"]
    assert len(c) == 25 and len(p["d_slide01", "d_slide01_01"]) == 2
    np.testing.assert_allclose(c[[0, 23, 24]], [(0, 0), (100, 100), (100, 0)], atol=1e-3)
    t = 11 / 23
    np.testing.assert_allclose(c[11, 0], 100 * (3 * (1 - t) * t * t * 0.5 + t**3), atol=1e-3)
    assert pictures.first()["width"] == 400
    assigned, problems = jobs.deck_labels(traces, labels)
    a = assigned.first()
    assert (a["label"], a["trace_index"]) == ("7", 0)
    q = problems.first()
    assert q["trace_index"] == 1 and q["problem"] == "no number nearby"
    deck(tmp_path / "closed.pptx", freeform((0, 0, 1, 1), line + "<a:close/>"))
    with pytest.raises(PythonException, match="is closed"):
        read_deck(spark, str(tmp_path / "closed.pptx"))
    deck(tmp_path / "two.pptx", "", pictures=2)
    with pytest.raises(PythonException, match="2 pictures"):
        read_deck(spark, str(tmp_path / "two.pptx"))


def test_two_decks_stay_apart(spark, tmp_path):
    line = f"<a:moveTo>{pts((0, 0))}</a:moveTo><a:lnTo>{pts((100, 100))}</a:lnTo>"
    for name in ("one", "other deck"):
        deck(tmp_path / f"{name}.pptx", freeform((1000, 2000, 1000, 1000), line))
    _, traces, _ = read_deck(spark, str(tmp_path))
    p = polylines(traces, "filament_id")
    assert {k: len(v) for k, v in p.items()} == {("one_slide01", "one_slide01_00"): 2, ("other deck_slide01", "other deck_slide01_00"): 2}


def test_csv_columns_by_file_and_odd_names(spark, tmp_path):
    (tmp_path / "my img+1%.csv").write_text('y,"X",filament_id\n1,10,f\n2,20,f\n')
    (tmp_path / "b.csv").write_text("filament_id,note,x,y,more\nf,\"a, b\",30,3,\ng,,1,1,\nf,,40,4,z\n")
    p = polylines(read_traces(spark, str(tmp_path), source="csv"), "filament_id")
    assert {k: v.tolist() for k, v in p.items()} == {("my img+1%", "f"): [[10, 1], [20, 2]], ("b", "f"): [[30, 3], [40, 4]]}


def test_named_mrc_files_only_and_large_ones_shared_out(spark, tmp_path):
    a = RNG.normal(size=(300, 410)).astype(np.float32)
    for name in ("m1", "m2", "m3"):
        write_mrc(str(tmp_path / f"{name}.mrc"), a, 3.3)
    (tmp_path / "broken.mrc").write_bytes(b"no header")
    one = read_mrc(spark, str(tmp_path), tile=64, task_bytes=100_000, only=["m2"])
    np.testing.assert_array_equal(assemble(one, a.shape), a)  # the broken file is not opened
    assert one.rdd.getNumPartitions() == 5  # 493,024 bytes
    some = read_mrc(spark, str(tmp_path), tile=64, only=["m1", "m3"]).filter("ty = 0")
    assert {(r["image_id"], r["ty"]) for r in some.collect()} == {("m1", 0), ("m3", 0)}
    heads = read_mrc_headers(spark, str(tmp_path), only=["m3"])
    assert [r["image_id"] for r in heads.collect()] == ["m3"]
    assert read_mrc(spark, str(tmp_path), only=[]).count() == read_mrc_headers(spark, str(tmp_path), only=["none"]).count() == 0
    tiny = read_mrc(spark, str(tmp_path / "m1.mrc"), tile=512, task_bytes=1000)  # more shares than bands
    np.testing.assert_array_equal(assemble(tiny, a.shape), a)


def test_mapping_table(spark, tmp_path):
    path = str(tmp_path / "map")

    def rows(*r):
        return spark.createDataFrame([(i, "p", 1.0, 4.0, 4.0, s) for i, s in r], sinks.MAPPING)

    sinks.upsert_mapping(spark, rows(("b", 0.9), ("a", 0.91)), path)
    merged = sinks.upsert_mapping(spark, rows(("b", 0.95), ("c", 0.99)), path)
    assert {r["image_id"]: r["match_score"] for r in merged.collect()} == {"a": 0.91, "b": 0.95, "c": 0.99}


def test_a_failed_upsert_keeps_the_mapping(spark, tmp_path):
    path = str(tmp_path / "map")
    one = spark.createDataFrame([("a", "p", 1.0, 4.0, 4.0, 0.9)], sinks.MAPPING)
    sinks.upsert_mapping(spark, one, path)
    broken = one.withColumn("match_score", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        sinks.upsert_mapping(spark, broken, path)
    assert [r["match_score"] for r in sinks.read_mapping(spark, path).collect()] == [0.9]
    for score in (0.91, 0.92, 0.93):
        old = sinks.read_mapping(spark, path)
        sinks.upsert_mapping(spark, one.withColumn("match_score", F.lit(score)), path)
        assert old.count() == 1  # a reader of the version before is not disturbed
    assert [r["match_score"] for r in sinks.read_mapping(spark, path).collect()] == [0.93]
    assert len(commit.versions(spark, path)) == 2 and not [p for p in os.listdir(path) if p.startswith(".v")]


def test_tables_change_together_or_not_at_all(spark, tmp_path):
    good = spark.createDataFrame([(1,)], "v int")
    bad = good.select(F.raise_error(F.lit("lost")).cast("int").alias("v"))
    sinks.write_tables({"one": good, "two": good}, str(tmp_path), {"n": 1})
    with pytest.raises(Exception, match="lost"):
        sinks.write_tables({"one": good.limit(0), "two": bad}, str(tmp_path), {"n": 2})
    assert [spark.read.csv(str(tmp_path / t), header=True).count() for t in ("one", "two")] == [1, 1]
    assert json.loads((tmp_path / "summary.json").read_text()) == {"n": 1}
    sinks.write_tables({"one": good.union(good)}, str(tmp_path), {"n": 3})
    assert spark.read.csv(str(tmp_path / "one"), header=True).count() == 2
    assert json.loads((tmp_path / "summary.json").read_text()) == {"n": 3}
    assert sorted(p for p in os.listdir(tmp_path) if "stage" in p) == []


def test_overlays_show_when_all_tasks_ended_well(spark, tmp_path):
    rows = spark.range(6).repartition(3).selectExpr("concat('i', id) image_id", "0 ty", "1 tx", "encode(string(id), 'utf-8') png")
    folder = tmp_path / "over"
    bad = rows.withColumn("png", F.when(F.col("image_id") == "i4", F.raise_error(F.lit("lost"))).otherwise(F.col("png")))
    with pytest.raises(Exception, match="lost"):
        sinks.save_overlays(bad, str(folder))
    assert not folder.exists() or os.listdir(folder) == []
    sinks.save_overlays(rows, str(folder))
    assert {p.name: p.read_text() for p in folder.iterdir()} == {f"overlay_i{k}_0_1.png": str(k) for k in range(6)}
    sinks.save_overlays(rows.limit(0), str(folder))
    assert len(os.listdir(folder)) == 6


def test_run_log(spark, tmp_path):
    for loss in (0.5, 0.4):
        sinks.write_run(spark, {"run": "r1", "finished_at": f"2026-01-0{int(loss * 10)}", "best_val_loss": loss, "args": {"pos_weight": "3"}, "curve": [1, 2]}, str(tmp_path))
    sinks.write_run(spark, {"run": "r2", "best_val_loss": 0.7}, str(tmp_path))
    assert json.loads(spark.read.text(str(tmp_path / "r1.json")).first()[0])["best_val_loss"] == 0.4
    log = sinks.read_run_log(spark, str(tmp_path / "training_runs.jsonl"))
    assert log.count() == 3
    scores = spark.createDataFrame(
        [("r1", 0.5, 0.6, 1, 4, 10), ("r1", 0.7, 0.8, 2, 4, 20), ("r2", 0.1, 0.9, 0, 0, 5), ("r3", 0.1, 0.2, 1, 1, 5)],
        "run string, dice_labelled double, mean_coverage double, matched long, n_manual long, n_detected long",
    )
    got = jobs.compare_runs(scores, log).collect()
    assert [r["run"] for r in got] == ["r2", "r1", "r3"]
    assert got[1]["pos_weight"] == "3" and got[1]["best_val_loss"] == 0.5 and got[1]["recall"] == 3 / 8
    assert got[0]["recall"] is None and got[2]["pos_weight"] == "?"


def test_label_cache_keys(spark):
    when = datetime(2026, 1, 1)
    images = spark.createDataFrame([("a", 10, when), ("b", 20, when)], "image_id string, length long, modificationTime timestamp")
    traces = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "image_id string, content binary")
    one = jobs.label_keys(images, traces, {"width_px": 7})
    again = {r["image_id"]: r["key"] for r in jobs.label_keys(images, traces, {"width_px": 7}).collect()}
    assert {r["image_id"]: r["key"] for r in one.collect()} == again and all(len(k) == 64 for k in again.values())
    changed = traces.withColumn("content", F.when(F.col("image_id") == "a", F.lit(b"z")).otherwise(F.col("content")))
    stale = jobs.stale_images(jobs.label_keys(images, changed, {"width_px": 7}), one)
    assert [r["image_id"] for r in stale.collect()] == ["a"]
    assert jobs.stale_images(jobs.label_keys(images, traces, {"width_px": 5}), one).count() == 2


def test_config(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("pixel_size_a: 2.5\nunknown: 1\ntrace:\n  bridge_gap_px: 60\ndetect:\n  sigmas: [2.0]\n")
    cfg = Config.from_yaml(f)
    assert cfg.pixel_size_a == 2.5 and cfg.trace.bridge_gap_px == 60 and cfg.detect.sigmas == [2.0]
    f.write_text("trace:\n  nonsense: 1\n")
    with pytest.raises(TypeError):
        Config.from_yaml(f)


def test_command_line(spark, tmp_path):
    img, curves = jobs.synthetic_micrograph((160, 200), n=2, seed=4)
    write_mrc(str(tmp_path / "demo.mrc"), img, 5.0)
    lines = "".join(f"c{k},{x},{y}\n" for k, c in enumerate(curves) for x, y in c)
    (tmp_path / "rois.csv").write_text("filament_id,x,y\n" + lines)
    out = str(tmp_path / "out")
    for _ in range(2):
        cli(["metrics-from-rois", str(tmp_path / "demo.mrc"), str(tmp_path / "rois.csv"), "--patient", "P1", "--out", out])
    rows = sinks.read_per_image(spark, f"{out}/per_image")
    assert rows.count() == 4 and {r["image_id"] for r in rows.collect()} == {"demo"}
    true = float(np.hypot(*np.diff(curves[0], axis=0).T).sum())
    got = rows.filter("filament_id = 'c0'").first()["length"]
    assert got == pytest.approx(true * 0.5, rel=0.02)
    assert len(list((tmp_path / "out" / "overlays").glob("*.png"))) == 1
    cli(["summarize", f"{out}/per_image", "--out", f"{out}/per_patient"])
    s = spark.read.option("header", True).csv(f"{out}/per_patient")
    assert s.count() == len(METRICS) and {r["n"] for r in s.collect()} == {"4"}
    cli(["trace", str(tmp_path / "demo.mrc"), "--patient", "P2", "--out", out, "--no-overlay"])
    assert sinks.read_per_image(spark, f"{out}/per_image").filter("patient_id = 'P2'").count() >= 1


def test_no_fibrils_gives_an_empty_table(spark, tmp_path):
    write_mrc(str(tmp_path / "flat.mrc"), np.ones((64, 64), np.float32), 5.0)
    tiles = read_mrc(spark, str(tmp_path / "flat.mrc"))
    per_image, _ = jobs.trace_and_measure(tiles, image_table(tiles), patient_id="P")
    assert per_image.columns == PER_IMAGE.fieldNames() and per_image.count() == 0


def test_streaming_append(spark, tmp_path):
    (tmp_path / "in").mkdir()
    images = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "image_id string, pixel_size_nm double")
    line = "filament_id,x,y\n" + "".join(f"f,{k},0\n" for k in range(11))

    def run():
        measure_new_traces(
            spark, str(tmp_path / "in"), images, str(tmp_path / "out"), str(tmp_path / "ckpt"), patient_id="P"
        ).awaitTermination(120)

    (tmp_path / "in" / "a.csv").write_text(line)
    run()
    (tmp_path / "in" / "b.csv").write_text(line)
    run()
    got = {r["image_id"]: r["length"] for r in sinks.read_per_image(spark, str(tmp_path / "out")).collect()}
    assert got == pytest.approx({"a": 5.0, "b": 10.0})


def test_label_totals(spark):
    counts = spark.createDataFrame([("a", 10, 5, 100), ("b", 30, 15, 100)], "image_id string, positive long, ignored long, pixels long")
    r = jobs.label_totals(counts, points_df(spark, {"f": [(0, 0)], "g": [(0, 0)]}, "a")).first()
    assert (r["positive_fraction"], r["ignored_fraction"], r["n_fibrils"]) == (0.2, 0.1, 2)


def test_validation_job(spark, tmp_path):
    from helpers import bool_tiles, float_tiles

    shape = (160, 320)
    mask = draw(shape, [((20, 40), (300, 40)), ((20, 120), (300, 120))])
    truth = draw(shape, [((20, 42), (300, 42)), ((20, 80), (300, 80))])
    manual = points_df(spark, {"hit": [(20, 42), (300, 42)], "miss": [(20, 80), (300, 80)]})
    manual = jobs.resample(manual)
    out = jobs.validate(
        float_tiles(spark, {"img": mask.astype(float)}, 128),
        bool_tiles(spark, {"img": truth}, 128),
        bool_tiles(spark, {"img": np.zeros(shape)}, 128),
        manual,
        tile=128,
    )
    r = out["per_image"].first()
    assert (r["n_manual"], r["n_detected"], r["matched"], r["fibrils_80pct_covered"]) == (2, 2, 1, 1)
    assert r["recall"] == 0.5 and r["mean_coverage"] == pytest.approx(0.5, abs=0.02)
    m = out["matched_fibrils"].first()
    assert m["gt_index"] == "hit" and m["centerline_distance_px"] == pytest.approx(2, abs=0.2)
    assert out["metric_errors"].count() == len(METRICS)
    s = out["summary"].first()
    assert s["overall_recall"] == 0.5 and s["n_images"] == 1
    tables = {k: v for k, v in out.items() if k != "summary"}
    sinks.write_tables(tables, str(tmp_path), out["summary"])
    assert json.loads((tmp_path / "summary.json").read_text())["total_matched"] == 1
    assert spark.read.option("header", True).csv(str(tmp_path / "matched_fibrils")).count() == 1
    folds = spark.createDataFrame([(0, "img", "test"), (1, "img", "train")], "fold int, image_id string, split string")
    cv = jobs.cross_validate(out["per_image"], out["matched_fibrils"], folds)
    assert cv["recall"].first()["recall"] == 0.5


def test_validation_plans_stay_small(spark, monkeypatch):
    """What makes the curves is planned once, not in every place that reads them."""
    from helpers import bool_tiles, float_tiles
    from pyspark.sql.classic.dataframe import DataFrame

    shape, nodes, checkpoint = (64, 128), [], DataFrame.checkpoint

    def counted(df, *args, **kwargs):
        nodes.append(df._jdf.queryExecution().analyzed().toString().count("\n"))
        return checkpoint(df, *args, **kwargs)

    monkeypatch.setattr(DataFrame, "checkpoint", counted)
    mask = draw(shape, [((10, 30), (110, 30))])
    manual = jobs.resample(points_df(spark, {"f": [(10, 32), (110, 32)]}))
    tiles = bool_tiles(spark, {"img": mask}, 64)
    out = jobs.validate(float_tiles(spark, {"img": mask.astype(float)}, 64), tiles, tiles, manual, tile=64)
    assert out["per_image"].first()["matched"] == 1
    assert max(nodes) < 300, nodes


def test_validation_of_a_labelled_set(spark, tmp_path):
    (tmp_path / "set" / "images").mkdir(parents=True)
    (tmp_path / "set" / "traces").mkdir()
    for k in range(2):
        img, curves = jobs.synthetic_micrograph((128, 160), n=2, seed=k)
        grey = np.clip(255 * (img - img.min()) / np.ptp(img), 0, 255).astype(np.uint8)
        (tmp_path / "set" / "images" / f"m{k}.png").write_bytes(png_bytes(grey))
        lines = "".join(f"c{i},{x},{y}\n" for i, c in enumerate(curves) for x, y in c)
        (tmp_path / "set" / "traces" / f"m{k}.csv").write_text("filament_id,x,y\n" + lines)
    folder, out = str(tmp_path / "set"), str(tmp_path / "out")
    tables = jobs.validate_set(spark, folder, out, snap=False)
    assert tables["per_image"].count() == 2
    assert spark.read.option("header", True).csv(f"{out}/per_image_validation").count() == 2
    assert json.loads((tmp_path / "out" / "summary.json").read_text())
    first = {r["run"] for r in spark.read.parquet(f"{folder}/labels/done").collect()}
    # Only the image whose traces changed is labelled again.
    text = (tmp_path / "set" / "traces" / "m1.csv").read_text()
    (tmp_path / "set" / "traces" / "m1.csv").write_text(text + "new,1,1\nnew,90,90\n")
    jobs.validate_set(spark, folder, out, snap=False)
    done = spark.read.parquet(f"{folder}/labels/done").collect()
    assert [r["image_id"] for r in done if r["run"] not in first] == ["m1"] and len(first) == 1


def test_cross_validation_and_run_comparison_as_commands(spark, tmp_path):
    for part in ("images", "traces"):
        (tmp_path / "set" / part).mkdir(parents=True)
    for k in range(3):
        img, curves = jobs.synthetic_micrograph((96, 128), n=1, seed=k)
        grey = np.clip(255 * (img - img.min()) / np.ptp(img), 0, 255).astype(np.uint8)
        (tmp_path / "set" / "images" / f"m{k}.png").write_bytes(png_bytes(grey))
        lines = "".join(f"c{i},{x},{y}\n" for i, c in enumerate(curves) for x, y in c)
        (tmp_path / "set" / "traces" / f"m{k}.csv").write_text("filament_id,x,y\n" + lines)
    folder, out = str(tmp_path / "set"), str(tmp_path / "out")
    cli(["cross-validate", folder, "--folds", "2", "--n-val", "0", "--name", "two", "--out", out])
    read = lambda t: spark.read.option("header", True).csv(f"{out}/{t}")
    rows = read("two_per_image").collect()
    assert sorted(r["image_id"] for r in rows) == ["m0", "m1", "m2"] and {r["fold"] for r in rows} == {"0", "1"}
    assert read("two_metric_errors").count() == len(METRICS)
    s = json.loads((tmp_path / "out" / "two_summary.json").read_text())
    assert (s["n_images"], s["folds"], len(s["per_fold"])) == (3, 2, 2)
    assert s["matched"] == sum(f["matched"] for f in s["per_fold"]) == read("two_matched_fibrils").count()
    (tmp_path / "plain.yaml").write_text("detect:\n  prob_threshold: 0.2\n")
    (tmp_path / "blind.yaml").write_text("detect:\n  prob_threshold: 1.5\n")
    cli(["compare-runs", folder, str(tmp_path / "blind.yaml"), str(tmp_path / "plain.yaml"), "--out", out])
    got = json.loads((tmp_path / "out" / "sweep_comparison.json").read_text())
    assert [r["run"] for r in got] == ["plain", "blind"]
    assert (got[1]["objects"], got[1]["coverage"], got[1]["recall"], got[1]["pos_weight"]) == (0.0, 0.0, 0.0, "?")


def test_deck_outputs(spark, tmp_path):
    line = f"<a:moveTo>{pts((0, 0))}</a:moveTo><a:lnTo>{pts((100, 100))}</a:lnTo>"
    (tmp_path / "in").mkdir()
    deck(tmp_path / "in" / "a.pptx", freeform((1000, 2000, 1000, 1000), line))
    deck(tmp_path / "in" / "b.pptx", "")
    got = {(r["image_id"], r["problem"]) for r in jobs.import_decks(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()}
    assert got == {("a_slide01", "no number nearby"), ("b_slide01", "no traces")}
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "traces")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "pictures")).count() == 2


def test_demo_as_a_command(spark, tmp_path):
    from strandflow import cli

    cli.main(["demo", "--images", "2", "--size", "160", "--seed", "4", "--out", str(tmp_path)])
    names = {p.relative_to(tmp_path).as_posix() for part in ("micrographs", "images", "traces") for p in (tmp_path / part).glob("demo*")}
    ends = {"micrographs": "mrc", "images": "png", "traces": "csv"}
    assert names == {f"{part}/demo_000{k}.{end}" for part, end in ends.items() for k in range(2)}
    for k in range(2):
        image, courses = jobs.synthetic_micrograph((160, 160), 6, 4 + k)
        raw = (tmp_path / "micrographs" / f"demo_000{k}.mrc").read_bytes()
        np.testing.assert_array_equal(np.frombuffer(raw[1024:], "<f4").reshape(160, 160), image)
        drawn = (tmp_path / "traces" / f"demo_000{k}.csv").read_text().splitlines()
        assert len(drawn) == 1 + sum(map(len, courses))
    rows = sinks.read_per_image(spark, str(tmp_path / "per_image")).collect()
    assert {r["patient_id"] for r in rows} == {"demo"} and {r["image_id"] for r in rows} <= {"demo_0000", "demo_0001"}
    assert spark.read.option("header", True).csv(str(tmp_path / "per_patient")).count() == 7
