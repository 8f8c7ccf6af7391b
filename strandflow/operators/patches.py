"""Overlapping patches of tiled micrographs: prediction, stitching, training rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.operators.ridge import normalize_tiles
from strandflow.operators.tiles import GRID, TILE, as_array, map_groups, map_rows, pack, plain, tile_schema, unpacked
from strandflow.session import whole

Predictor = Callable[[np.ndarray], np.ndarray]


def _starts(extent: int, patch: int, overlap: int) -> list[int]:
    if extent <= patch:
        return [0]
    regular = set(range(0, extent - patch + 1, patch - overlap))
    return sorted(regular | {extent - patch})


def blend_window(patch: int, taper: float = 0.25) -> np.ndarray:
    """Raised-cosine weights, 1 inside, falling to the border, never below 0.001."""
    ramp = max(int(round(patch * taper)), 1)
    edge = np.minimum(np.arange(patch), np.arange(patch)[::-1])
    side = np.where(edge < ramp, 0.5 * (1 - np.cos(np.pi * (edge + 1) / (ramp + 1))), 1.0)
    return np.maximum(np.outer(side, side), 1e-3)


def patches_of(
    tiles: DataFrame, *, patch: int = 256, overlap: int = 64, dtype: type = np.float32, tile: int = TILE, packed: bool = False
) -> DataFrame:
    """Patch rows (image_id, y, x, height, width, pixels): each tile sends the parts it holds.

    A patch reaching past a small image is completed by reflection.
    """
    if overlap >= patch:
        raise ValueError(f"patches of {patch} cannot share {overlap} pixels")
    id_field = tiles.schema["image_id"]
    ints = [T.StructField(c, T.IntegerType()) for c in ("py", "px", "y0", "x0", "h", "w", "height", "width")]
    pieces_schema = T.StructType([id_field, *ints, T.StructField("pixels", T.BinaryType())])

    def send(row: dict) -> list[dict]:
        a, out = as_array(row, dtype), []
        for py in _starts(row["height"], patch, overlap):
            ya, yb = max(py, row["y0"]), min(py + patch, row["y0"] + row["h"])
            if ya >= yb:
                continue
            for px in _starts(row["width"], patch, overlap):
                xa, xb = max(px, row["x0"]), min(px + patch, row["x0"] + row["w"])
                if xa < xb:
                    part = pack(a[ya - row["y0"] : yb - row["y0"], xa - row["x0"] : xb - row["x0"]])
                    out.append(
                        {**row, "py": py, "px": px, "y0": ya, "x0": xa, "h": yb - ya, "w": xb - xa, "pixels": part}
                    )
        return out

    schema = T.StructType(
        [id_field, *[T.StructField(c, T.IntegerType()) for c in ("y", "x", "height", "width")], T.StructField("pixels", T.BinaryType())]
    )
    def join(rows: list[dict]) -> list[dict]:
        head = rows[0]
        h, w = min(patch, head["height"] - head["py"]), min(patch, head["width"] - head["px"])
        a = np.zeros((h, w), dtype=dtype)
        for r in rows:
            y, x = r["y0"] - head["py"], r["x0"] - head["px"]
            a[y : y + r["h"], x : x + r["w"]] = as_array(r, dtype)
        if h < patch or w < patch:
            a = np.pad(a, ((0, patch - h), (0, patch - w)), mode="reflect")
        return [{**head, "y": head["py"], "x": head["px"], "pixels": (pack if packed else plain)(a)}]

    return map_groups(map_rows(tiles, send, pieces_schema), ["image_id", "py", "px"], join, schema)


def predict_patches(patches: DataFrame, load: Callable[[], Predictor], *, patch: int = 256, batch: int = 8) -> DataFrame:
    """Run a detector on patches in batches. ``load`` builds it once per task.

    The detector maps (n, patch, patch) float32 to probabilities of that shape.
    """

    schema = to_arrow_schema(patches.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = load()
        for records in batches:
            for start in range(0, records.num_rows, batch):
                rows = records.slice(start, batch).to_pylist()
                stack = np.stack([np.frombuffer(r["pixels"], np.float32).reshape(patch, patch) for r in rows])
                prob = np.asarray(detector(stack), dtype=np.float32)
                out = [{**r, "pixels": np.ascontiguousarray(p).tobytes()} for r, p in zip(rows, prob, strict=True)]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return patches.mapInArrow(run, patches.schema)


def stitch_patches(patches: DataFrame, *, patch: int = 256, tile: int = TILE, packed: bool = False) -> DataFrame:
    """Patches to float tiles by weighted mean; each patch sends its part to every tile it meets."""
    id_field = patches.schema["image_id"]
    schema = tile_schema(id_type=id_field.dataType)
    # A patch's corner says which weights a part of it has: they do not travel.
    pieces_schema = tile_schema([T.StructField(c, T.IntegerType()) for c in ("py", "px")], id_type=id_field.dataType)
    weights = blend_window(patch)

    def send(row: dict) -> list[dict]:
        a = np.frombuffer(unpacked(row["pixels"], 4 * patch * patch), np.float32).reshape(patch, patch)
        yb, xb = min(row["y"] + patch, row["height"]), min(row["x"] + patch, row["width"])
        out = []
        for ty in range(row["y"] // tile, (yb - 1) // tile + 1):
            for tx in range(row["x"] // tile, (xb - 1) // tile + 1):
                y0, y1 = max(row["y"], ty * tile), min(yb, (ty + 1) * tile)
                x0, x1 = max(row["x"], tx * tile), min(xb, (tx + 1) * tile)
                out.append(
                    {
                        "image_id": row["image_id"], "ty": ty, "tx": tx, "y0": y0, "x0": x0,
                        "h": y1 - y0, "w": x1 - x0, "height": row["height"], "width": row["width"],
                        "py": row["y"], "px": row["x"],
                        "pixels": pack(a[y0 - row["y"] : y1 - row["y"], x0 - row["x"] : x1 - row["x"]]),
                    }
                )
        return out

    def join(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: (r["y0"], r["x0"], r["h"], r["w"]))
        head = rows[0]
        y0, x0 = head["ty"] * tile, head["tx"] * tile
        h, w = min(tile, head["height"] - y0), min(tile, head["width"] - x0)
        total, weight = np.zeros((h, w)), np.zeros((h, w))
        for r in rows:
            at = np.s_[r["y0"] - y0 : r["y0"] - y0 + r["h"], r["x0"] - x0 : r["x0"] - x0 + r["w"]]
            own = weights[r["y0"] - r["py"] : r["y0"] - r["py"] + r["h"], r["x0"] - r["px"] : r["x0"] - r["px"] + r["w"]]
            total[at] += as_array(r).astype(float) * own
            weight[at] += own
        mean = (total / np.maximum(weight, 1e-8)).astype(np.float32)
        return [{**head, "y0": y0, "x0": x0, "h": h, "w": w, "pixels": (pack if packed else plain)(mean)}]

    return map_groups(map_rows(patches, send, pieces_schema), GRID, join, schema)


def predict_tiles(
    tiles: DataFrame, load: Callable[[], Predictor], *, patch: int = 256, overlap: int = 64, batch: int = 8, tile: int = TILE
) -> DataFrame:
    """Probability tiles of any detector: normalise, cut, predict, blend."""
    cut = patches_of(normalize_tiles(tiles), patch=patch, overlap=overlap, tile=tile)
    return stitch_patches(predict_patches(cut, load, patch=patch, batch=batch), patch=patch, tile=tile)


def symmetric(arrays: Sequence[np.ndarray], which: int) -> list[np.ndarray]:
    """Every array under the same of the square's eight symmetries: bit 0 swaps the axes, bits 1 and 2 turn them round."""
    rows, cols = slice(None, None, -1 if which & 2 else 1), slice(None, None, -1 if which & 4 else 1)
    return [np.ascontiguousarray((a.T if which & 1 else a)[rows, cols]) for a in arrays]


def training_patches(
    image: DataFrame, mask: DataFrame, ignore: DataFrame, *, patch: int = 256, overlap: int = 64,
    min_positive: int = 20, seed: int | None = None, tile: int = TILE,
) -> DataFrame:
    """Patch rows with ``pixels``, ``mask`` and ``weight`` (0 on unknown pixels).

    Patches with hardly any annotation are left out: with partial annotation an
    empty patch is no trustworthy negative. ``seed`` turns augmentation on: a hash
    of seed and patch picks its symmetry, so results do not depend on partitioning.
    """
    key = ["image_id", "y", "x"]
    size = {"patch": patch, "overlap": overlap, "tile": tile}
    x = patches_of(image, **size)
    m = patches_of(mask, dtype=np.uint8, **size).select(*key, F.col("pixels").alias("mask"))
    g = patches_of(ignore, dtype=np.uint8, **size).select(*key, F.col("pixels").alias("ignore"))
    both = x.join(whole(m), key).join(whole(g), key, "left")
    schema = T.StructType(
        [*x.schema.fields, T.StructField("mask", T.BinaryType()), T.StructField("weight", T.BinaryType())]
    )

    def build(row: dict) -> list[dict]:
        a = np.frombuffer(row["pixels"], np.float32).reshape(patch, patch)
        t = np.frombuffer(row["mask"], np.uint8).reshape(patch, patch)
        if t.sum() < min_positive:
            return []
        unknown = np.frombuffer(row["ignore"], np.uint8) if row["ignore"] else np.zeros(patch * patch, np.uint8)
        w = 1 - unknown.reshape(patch, patch)
        if seed is not None:
            a, t, w = symmetric([a, t, w], crc32(f"{seed}:{row['image_id']}:{row['y']}:{row['x']}".encode()) & 7)
        return [{**row, "pixels": a.tobytes(), "mask": t.tobytes(), "weight": w.astype(np.uint8).tobytes()}]

    return map_rows(both, build, schema)


def dice_bce(logit: Column, target: Column, weight: Column, *, pos_weight: float = 10.0, eps: float = 1e-6) -> Column:
    """Aggregate: weighted cross entropy plus soft Dice over the weighted pixels.

    Values of different ``pos_weight`` are on different scales; do not rank them.
    """
    soft = F.log1p(F.exp(-F.abs(logit))) + F.greatest(-logit, F.lit(0.0))
    bce = (F.lit(1.0) - target) * logit + (F.lit(1.0) + (pos_weight - 1.0) * target) * soft
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(-logit)) * weight
    hit = target * weight
    mean = F.sum(bce * weight) / F.greatest(F.sum(weight), F.lit(eps))
    dice = F.lit(1.0) - (2.0 * F.sum(prob * hit) + eps) / (F.sum(prob) + F.sum(hit) + eps)
    return mean + dice
