"""Micrographs in MRC files as tiles.

Layout from the public MRC2014 description: a 1024-byte header of 4-byte words,
an optional extended header, then the pixels, x fastest.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from strandflow.operators.tiles import TILE, map_rows, tile_schema

HEADER_BYTES = 1024

# Fixed values of the format: pixel type by mode word.
MODES = {0: "i1", 1: "i2", 2: "f4", 6: "u2", 12: "f2"}

EXTRA = [T.StructField("pixel_size_a", T.DoubleType()), T.StructField("path", T.StringType())]


@dataclass(frozen=True)
class MrcHeader:
    width: int
    height: int
    sections: int
    dtype: np.dtype
    pixel_size_a: float | None
    offset: int

    def frame_offset(self, frame: int) -> int:
        if self.sections > 1 and not 0 <= frame < self.sections:
            raise IndexError(f"frame {frame} is out of range: the stack has {self.sections}")
        picked = frame if self.sections > 1 else 0
        return self.offset + picked * self.width * self.height * self.dtype.itemsize


def parse_header(head: bytes) -> MrcHeader:
    """Read the header; the machine stamp, or plausible sizes, decide the byte order."""
    if len(head) < HEADER_BYTES:
        raise ValueError("MRC header is shorter than 1024 bytes")
    little = head[212:214] not in (b"\x11\x11",)
    if head[212:213] not in (b"\x11", b"\x44"):
        little = 0 < struct.unpack_from("<i", head, 0)[0] < 1 << 20
    e = "<" if little else ">"
    nx, ny, nz, mode = struct.unpack_from(f"{e}4i", head, 0)
    mx = struct.unpack_from(f"{e}i", head, 28)[0]
    cell_x = struct.unpack_from(f"{e}f", head, 40)[0]
    group, extended = struct.unpack_from(f"{e}2i", head, 88)
    if mode not in MODES:
        raise ValueError(f"unsupported MRC mode {mode}")
    if 401 <= group <= 630:
        raise ValueError("unsupported MRC: a stack of volumes has four dimensions")
    size = cell_x / mx if mx and cell_x else None
    return MrcHeader(nx, ny, nz, np.dtype(e + MODES[mode]), size, HEADER_BYTES + max(extended, 0))


def mrc_bytes(image: np.ndarray, pixel_size_a: float) -> bytes:
    """A single little-endian float32 image as a file."""
    h, w = image.shape
    head = bytearray(HEADER_BYTES)
    struct.pack_into("<4i", head, 0, w, h, 1, 2)
    struct.pack_into("<3i", head, 28, w, h, 1)
    struct.pack_into("<3f", head, 40, w * pixel_size_a, h * pixel_size_a, pixel_size_a)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    head[208:212] = b"MAP "
    head[212:214] = b"\x44\x44"
    return bytes(head) + np.ascontiguousarray(image, dtype="<f4").tobytes()


def write_mrc(path: str, image: np.ndarray, pixel_size_a: float) -> None:
    with open(path, "wb") as fh:
        fh.write(mrc_bytes(image, pixel_size_a))


@dataclass
class _Files(InputPartition):
    """Files, and which of ``parts`` equal shares of their bands of tiles."""

    paths: list
    part: int = 0
    parts: int = 1


# Headers read by one task, bytes of a file read by one task, and bytes of tiles handed to Spark at once.
HEADERS_A_TASK, TASK_BYTES, BATCH_BYTES = 256, 64 << 20, 4 << 20
HEADER_ROW = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("pixel_size_a", T.DoubleType()),
        T.StructField("pixel_size_nm", T.DoubleType()),
    ]
)


class _MrcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.frame = int(options.get("frame", 0))
        self.tile = int(options.get("tile", TILE))
        size = options.get("pixel_size_a")
        self.pixel_size_a = float(size) if size not in (None, "") else None
        self.headers = str(options.get("headers", "")).lower() == "true"
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        only = options.get("only")
        self.only = set(json.loads(only)) if only is not None else None

    def named(self, path: str) -> bool:
        return self.only is None or os.path.splitext(os.path.basename(path))[0] in self.only

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.root):
            found = sorted(glob.glob(os.path.join(self.root, "*.mrc")))
        else:
            found = sorted(glob.glob(self.root))
        if not found:
            raise FileNotFoundError(f"no .mrc files at {self.root}")
        found = [path for path in found if self.named(path)]
        if self.headers:
            return [_Files(found[i : i + HEADERS_A_TASK]) for i in range(0, len(found), HEADERS_A_TASK)] or [_Files([])]
        shares = {path: max(1, -(-os.path.getsize(path) // self.task_bytes)) for path in found}
        return [_Files([path], k, n) for path, n in shares.items() for k in range(n)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator:
        return self.read_headers(partition) if self.headers else self.read_tiles(partition)

    def read_headers(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as fh:
                head = parse_header(fh.read(HEADER_BYTES))
            size = self.pixel_size_a if self.pixel_size_a is not None else (head.pixel_size_a or 1.0)
            yield os.path.splitext(os.path.basename(path))[0], path, head.height, head.width, size, size / 10

    def read_tiles(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        """One band of tiles is in memory at a time, and goes to Spark in batches of a few MB."""
        kind = to_arrow_schema(tile_schema(EXTRA))
        rows, held = [], 0
        for row in self.tiles(partition):
            rows.append(dict(zip(kind.names, row, strict=True)))
            held += len(row[9])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=kind)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    def tiles(self, partition: _Files) -> Iterator[tuple]:
        for path in partition.paths:
            with open(path, "rb") as fh:
                head = parse_header(fh.read(HEADER_BYTES))
                start = head.frame_offset(self.frame)
                image_id = os.path.splitext(os.path.basename(path))[0]
                size = self.pixel_size_a if self.pixel_size_a is not None else (head.pixel_size_a or 1.0)
                bands = -(-head.height // self.tile)
                for ty in range(bands * partition.part // partition.parts, bands * (partition.part + 1) // partition.parts):
                    y0 = ty * self.tile
                    rows = min(self.tile, head.height - y0)
                    fh.seek(start + y0 * head.width * head.dtype.itemsize)
                    band = np.frombuffer(fh.read(rows * head.width * head.dtype.itemsize), dtype=head.dtype)
                    band = band.reshape(rows, head.width).astype(np.float32)
                    for tx, x0 in enumerate(range(0, head.width, self.tile)):
                        a = np.ascontiguousarray(band[:, x0 : x0 + self.tile])
                        yield (
                            image_id, ty, tx, y0, x0, a.shape[0], a.shape[1],
                            head.height, head.width, a.tobytes(), size, path,
                        )


class MrcDataSource(DataSource):
    """``spark.read.format("mrc").option("frame", 0).option("pixel_size_a", 3.3).load(path)``."""

    @classmethod
    def name(cls) -> str:
        return "mrc"

    def schema(self) -> T.StructType:
        return HEADER_ROW if str(self.options.get("headers", "")).lower() == "true" else tile_schema(EXTRA)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MrcReader(self.options)


def read_mrc(
    spark: SparkSession,
    path: str,
    *,
    frame: int = 0,
    pixel_size_a: float | None = None,
    tile: int = TILE,
    task_bytes: int = TASK_BYTES,
    only: Sequence[str] | None = None,
) -> DataFrame:
    """Tiles of every micrograph at ``path`` (file, folder or pattern on a mounted disk).

    With ``only`` (image ids) no other file is opened. A file of over ``task_bytes``
    is read by several tasks, each a share of its bands of tiles.
    """
    spark.dataSource.register(MrcDataSource)
    reader = spark.read.format("mrc").option("frame", frame).option("tile", tile).option("task_bytes", task_bytes)
    return _loaded(reader, path, pixel_size_a, only)


def _loaded(reader: DataFrameReader, path: str, pixel_size_a: float | None, only: Sequence[str] | None) -> DataFrame:
    if pixel_size_a is not None:
        reader = reader.option("pixel_size_a", pixel_size_a)
    if only is not None:
        reader = reader.option("only", json.dumps(list(only)))
    return reader.load(path)


def read_mrc_headers(
    spark: SparkSession, path: str, *, pixel_size_a: float | None = None, only: Sequence[str] | None = None
) -> DataFrame:
    """What ``image_table`` gives, from the headers alone: no pixel is read."""
    spark.dataSource.register(MrcDataSource)
    return _loaded(spark.read.format("mrc").option("headers", True), path, pixel_size_a, only)


def decode_mrc(
    files: DataFrame, *, frame: int = 0, pixel_size_a: float | None = None, tile: int = TILE
) -> DataFrame:
    """The same tiles from ``spark.read.format("binaryFile")`` rows (object stores)."""

    def decode(row: dict) -> list[dict]:
        head = parse_header(row["content"][:HEADER_BYTES])
        start = head.frame_offset(frame)
        a = np.frombuffer(row["content"], head.dtype, head.width * head.height, start)
        a = a.reshape(head.height, head.width).astype(np.float32)
        size = pixel_size_a if pixel_size_a is not None else (head.pixel_size_a or 1.0)
        out = []
        for ty, y0 in enumerate(range(0, head.height, tile)):
            for tx, x0 in enumerate(range(0, head.width, tile)):
                part = np.ascontiguousarray(a[y0 : y0 + tile, x0 : x0 + tile])
                out.append(
                    {
                        "image_id": row["image_id"], "ty": ty, "tx": tx, "y0": y0, "x0": x0,
                        "h": part.shape[0], "w": part.shape[1], "height": head.height, "width": head.width,
                        "pixels": part.tobytes(), "pixel_size_a": size, "path": row["path"],
                    }
                )
        return out

    return map_rows(with_image_id(files).select("image_id", "path", "content"), decode, tile_schema(EXTRA))


def with_image_id(files: DataFrame, path: str = "path") -> DataFrame:
    """``image_id`` is the file name without its last suffix."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    return files.withColumn("image_id", F.regexp_replace(name, r"\.[^.]*$", ""))


def image_table(tiles: DataFrame) -> DataFrame:
    """One row per micrograph: size and calibration (nm is a tenth of an Angstrom figure)."""
    return (
        tiles.groupBy("image_id")
        .agg(*[F.max(c).alias(c) for c in ("path", "height", "width", "pixel_size_a")])
        .withColumn("pixel_size_nm", F.col("pixel_size_a") / 10)
    )
