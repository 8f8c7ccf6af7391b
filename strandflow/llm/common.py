"""Helpers the text operators share: shared folders, fresh column names, list columns."""

from __future__ import annotations

import ctypes
import gc
import re
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.session import ensure_checkpoint_dir

#: Rows of one Arrow batch are worked on in slices of about this many text bytes.
SLICE_BYTES = 1 << 20
#: White space, which no word of any text operator holds.
SPACE = re.compile("[ \t-\r]")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: str, parts: int) -> Column:
    """``crc32`` of the id as text, modulo ``parts``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % parts


def new_folder(spark: SparkSession, what: str) -> str:
    """An unused folder below the checkpoint folder, which all executors see."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and its size is known."""
    spark = df.sparkSession
    path = new_folder(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with about ``size`` bytes each; NULL reads as empty text."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    place = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(column)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield a, [x or "" for x in column.slice(a, b - a).to_pylist()]


def pieces(column: pa.Array, size: int = 4 * SLICE_BYTES) -> Iterator[tuple[np.ndarray, pa.Array, bool]]:
    """(row of each text, texts, whether their rows end here), about ``size`` bytes at a time; NULL reads as empty text.

    Many short texts come together. One much longer than ``size`` comes alone, in
    pieces cut before a white space, each but the last with False.
    """
    column = pc.fill_null(column, "")
    lengths = np.asarray(pc.binary_length(column), dtype=np.int64)
    place = np.cumsum(lengths) // size
    cuts = np.unique(np.concatenate([[0, len(column)], np.flatnonzero(np.diff(place)) + 1, *(np.flatnonzero(lengths > 2 * size) + x for x in (0, 1))]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b > a + 1 or lengths[a] <= 2 * size:
            yield np.arange(a, b), column.slice(a, b - a), True
            continue
        text, start, row = column[a].as_py(), 0, np.array([a])
        while len(text) - start > size and (cut := SPACE.search(text, start + size)):
            yield row, pa.array([text[start : cut.start()]], column.type), False
            start = cut.start()
        yield row, pa.array([text[start:]], column.type), True


def give_back() -> None:
    """Hand memory that is free again back to the system, so that an idle worker does not hold a task's peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        ctypes.CDLL(None).malloc_trim(0)


def open_files(uri: str):
    """(file system, path) of a URI, for tasks that write or range-read binary files."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)
