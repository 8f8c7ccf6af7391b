"""8-bit pictures (PNG, TIFF) as tiles, and PNG output."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from strandflow.operators.ridge import normalize_tiles
from strandflow.operators.tiles import TILE, map_rows, tile_schema
from strandflow.sources.mrc import with_image_id

# Integer luminance weights (red, green, blue) out of 65536.
LUMINANCE = (19595, 38470, 7471)


def read_pictures(spark: SparkSession, path: str, *, tile: int = TILE) -> DataFrame:
    """Luminance tiles (0..255) of all pictures at ``path``; image_id is the file stem."""
    raw = spark.read.format("image").load(path).select("image.*")

    def cut(row: dict) -> list[dict]:
        a = np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["nChannels"])
        if a.shape[2] >= 3:
            blue, green, red = (a[:, :, k].astype(np.int64) for k in range(3))
            grey = (red * LUMINANCE[0] + green * LUMINANCE[1] + blue * LUMINANCE[2] + 0x8000) >> 16
        else:
            grey = a[:, :, 0]
        grey = grey.astype(np.float32)
        out = []
        for ty, y0 in enumerate(range(0, row["height"], tile)):
            for tx, x0 in enumerate(range(0, row["width"], tile)):
                part = np.ascontiguousarray(grey[y0 : y0 + tile, x0 : x0 + tile])
                out.append(
                    {
                        "image_id": row["image_id"], "ty": ty, "tx": tx, "y0": y0, "x0": x0,
                        "h": part.shape[0], "w": part.shape[1],
                        "height": row["height"], "width": row["width"], "pixels": part.tobytes(),
                    }
                )
        return out

    named = with_image_id(raw, "origin")
    return map_rows(named.select("image_id", "height", "width", "nChannels", "data"), cut, tile_schema())


def read_grayscale(spark: SparkSession, path: str, *, tile: int = TILE) -> DataFrame:
    """Pictures normalised to [0, 1] between their 1st and 99th percentile."""
    return normalize_tiles(read_pictures(spark, path, tile=tile))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png_bytes(pixels: np.ndarray) -> bytes:
    """8-bit PNG of an (h, w) grey or (h, w, 3) colour array."""
    a = np.ascontiguousarray(pixels, dtype=np.uint8)
    h, w = a.shape[:2]
    flat = a.reshape(h, -1)
    lines = np.concatenate([np.zeros((h, 1), dtype=np.uint8), flat], axis=1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if a.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines)) + _chunk(b"IEND", b"")


def picture_size(blob: bytes) -> tuple[int, int]:
    """(width, height) of a PNG or JPEG from its header."""
    if blob[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", blob[16:24])
    if blob[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(blob):
            marker, size = blob[at + 1], struct.unpack(">H", blob[at + 2 : at + 4])[0]
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", blob[at + 5 : at + 9])
                return width, height
            at += 2 + size
    raise ValueError("picture is neither PNG nor JPEG")
