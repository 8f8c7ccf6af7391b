"""Command line.

    python -m strandflow.cli metrics-from-rois img.mrc traces.csv --patient P1 --out outputs
    python -m strandflow.cli trace img.mrc --patient P1 --out outputs
    python -m strandflow.cli summarize outputs/per_image --out outputs/per_patient
    python -m strandflow.cli validate labelled_set --split val --out outputs/validation
    python -m strandflow.cli cross-validate labelled_set --folds 5 --out outputs/cv
    python -m strandflow.cli compare-runs labelled_set a.yaml b.yaml --reports reports/training_runs.jsonl
    python -m strandflow.cli match micrographs screenshots --mapping outputs/mapping
    python -m strandflow.cli import-deck decks --out outputs/decks
    python -m strandflow.cli demo --images 4 --out outputs/demo
"""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import functions as F

from strandflow.config import Config
from strandflow.operators.ridge import normalize_tiles
from strandflow.operators.stats import summarize_per_patient
from strandflow.plans import jobs
from strandflow.session import build_session
from strandflow.sources import sinks
from strandflow.sources.images import read_grayscale
from strandflow.sources.mrc import read_mrc, read_mrc_headers
from strandflow.sources.traces import read_traces


def _parser() -> argparse.ArgumentParser:
    ap = argparse.ArgumentParser(prog="strandflow", description="Filament tracing and morphology on Spark.")
    ap.add_argument("--master", default=None)
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("metrics-from-rois", "trace"):
        p = sub.add_parser(name)
        p.add_argument("mrc")
        if name == "metrics-from-rois":
            p.add_argument("traces")
        p.add_argument("--patient", required=True)
        p.add_argument("--out", default="outputs")
        p.add_argument("--pixel-size-a", type=float, default=None)
        p.add_argument("--config", default=None)
        p.add_argument("--no-overlay", dest="overlay", action="store_false")
    p = sub.add_parser("validate")
    p.add_argument("folder")
    p.add_argument("--split", choices=("train", "val", "test"), default=None)
    p.add_argument("--n-val", type=int, default=6)
    p.add_argument("--n-test", type=int, default=6)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--config", default=None)
    p.add_argument("--out", default="outputs/validation")
    p = sub.add_parser("cross-validate")
    p.add_argument("folder")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--n-val", type=int, default=6)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--pixel-size-nm", type=float, default=1.0)
    p.add_argument("--name", default="cv")
    p.add_argument("--config", default=None)
    p.add_argument("--out", default="outputs/cv")
    p = sub.add_parser("compare-runs")
    p.add_argument("folder")
    p.add_argument("configs", nargs="+", help="settings of each run, named after its file")
    p.add_argument("--reports", default=None)
    p.add_argument("--split", choices=("train", "val", "test"), default=None)
    p.add_argument("--n-val", type=int, default=6)
    p.add_argument("--n-test", type=int, default=6)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--out", default="outputs/runs")
    p = sub.add_parser("match")
    p.add_argument("micrographs")
    p.add_argument("screenshots")
    p.add_argument("--mapping", default="outputs/mapping")
    p = sub.add_parser("import-deck")
    p.add_argument("decks")
    p.add_argument("--out", default="outputs/decks")
    p = sub.add_parser("demo")
    p.add_argument("--images", type=int, default=4)
    p.add_argument("--size", type=int, default=512)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--out", default="outputs/demo")
    p = sub.add_parser("summarize")
    p.add_argument("per_image")
    p.add_argument("--out", default="outputs/per_patient")
    p.add_argument("--bootstrap", action="store_true")
    return ap


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    spark = build_session(args.master)
    if args.command == "summarize":
        rows = sinks.read_per_image(spark, args.per_image)
        sinks.write_summary(summarize_per_patient(rows, bootstrap=args.bootstrap), args.out)
        return
    if args.command == "import-deck":
        jobs.import_decks(spark, args.decks, args.out).show(truncate=False)
        return
    if args.command == "demo":
        jobs.demo_set(spark, args.out, n=args.images, shape=(args.size, args.size), seed=args.seed)
        shots = f"{args.out}/micrographs"
        per_image, _ = jobs.trace_and_measure(read_mrc(spark, shots), read_mrc_headers(spark, shots), patient_id="demo")
        sinks.put_per_image(per_image, f"{args.out}/per_image", "demo")
        sinks.write_summary(summarize_per_patient(sinks.read_per_image(spark, f"{args.out}/per_image")), f"{args.out}/per_patient")
        return
    if args.command == "match":
        shots = read_grayscale(spark, args.screenshots)
        matches, warnings = jobs.match_and_record(read_mrc(spark, args.micrographs), shots, args.mapping)
        matches.show(truncate=False)
        if not warnings.isEmpty():
            print("screenshots of several pixel sizes:", warnings.first()["pixel_sizes_a"])
        return
    if args.command == "compare-runs":
        runs = {Path(c).stem: (Config.from_yaml(c), None) for c in args.configs}
        if len(runs) < len(args.configs):
            raise SystemExit("two runs of one name: name the settings files apart")
        jobs.compare_set(
            spark, args.folder, args.out, runs, reports=args.reports, split=args.split, n_val=args.n_val, n_test=args.n_test, seed=args.seed
        ).show(truncate=False)
        return
    cfg = Config.from_yaml(args.config) if args.config else Config()
    if args.command == "cross-validate":
        tables = jobs.cross_validate_set(
            spark, args.folder, args.out, name=args.name, n_folds=args.folds, n_val=args.n_val,
            seed=args.seed, pixel_size=args.pixel_size_nm, config=cfg,
        )
        tables["recall"].show(truncate=False)
        tables["metric_errors"].show(truncate=False)
        return
    if args.command == "validate":
        jobs.validate_set(
            spark, args.folder, args.out, split=args.split, n_val=args.n_val, n_test=args.n_test, seed=args.seed, config=cfg
        )["summary"].show(truncate=False)
        return
    if args.pixel_size_a is not None:
        cfg.pixel_size_a = args.pixel_size_a
    tiles = read_mrc(spark, args.mrc, pixel_size_a=cfg.pixel_size_a)
    images = read_mrc_headers(spark, args.mrc, pixel_size_a=cfg.pixel_size_a)
    if args.command == "trace":
        per_image, curves = jobs.trace_and_measure(tiles, images, patient_id=args.patient, config=cfg)
    else:
        # One micrograph and one trace file per call: they belong together whatever their names.
        image_id = images.first()["image_id"]
        traces = read_traces(spark, args.traces)
        traces = traces.withColumn("image_id", F.lit(image_id))
        per_image = jobs.metrics_from_traces(images, traces, patient_id=args.patient, config=cfg)
        curves = jobs.finish(traces, jobs.Layout(), step=cfg.trace.resample_step, window=cfg.trace.smooth_window)
    sinks.append_per_image(per_image, f"{args.out}/per_image")
    if args.overlay:
        shown = normalize_tiles(tiles, eps=1e-9)
        sinks.save_overlays(sinks.overlay_tiles(shown, curves), f"{args.out}/overlays")


if __name__ == "__main__":
    main()
