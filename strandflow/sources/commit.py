"""Replacing tables and files as a whole: a reader sees the old state or the new one.

Tables are written beside the old ones by Spark and put in place by name. What
tasks write themselves (pictures) goes through a data source whose files show
only once every task has ended well.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from uuid import uuid4

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

VERSION = re.compile(r"v(\d{12})-[0-9a-f]{32}")


def _store(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a maker of its path objects: any store that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def put_text(spark: SparkSession, text: str, path: str) -> None:
    """One small file, replaced as a whole: written under another name first."""
    store, at = _store(spark, path)
    parent, name = path.rsplit("/", 1)
    fresh = at(f"{parent}/.{name}-{uuid4().hex}")
    store.mkdirs(at(parent))
    out = store.create(fresh, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    if store.exists(at(path)):
        store.delete(at(path), False)
    if not store.rename(fresh, at(path)):
        raise OSError(f"could not put {path} in place")


def replace_tables(spark: SparkSession, folder: str, writes: dict[str, Callable[[str], None]]) -> None:
    """Replace tables of a folder together: nothing changes unless all of them could be written.

    ``writes``: by table name, a function that writes it at the path it is given.
    """
    store, at = _store(spark, folder)
    stage = f"{folder}/.stage-{uuid4().hex}"
    try:
        for name, write in writes.items():
            write(f"{stage}/new/{name}")
        store.mkdirs(at(f"{stage}/old"))
        for name in writes:
            here = at(f"{folder}/{name}")
            if store.exists(here):
                store.rename(here, at(f"{stage}/old/{name}"))
            if not store.rename(at(f"{stage}/new/{name}"), here):
                store.rename(at(f"{stage}/old/{name}"), here)
                raise OSError(f"could not put {folder}/{name} in place")
    finally:
        store.delete(at(stage), True)


# ---------------------------------------------------------------- versions


def versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a versioned table, oldest first."""
    store, at = _store(spark, path)
    if not store.exists(at(path)):
        return []
    names = [s.getPath().getName() for s in store.listStatus(at(path))]
    return [f"{path}/{n}" for n in sorted(names) if VERSION.fullmatch(n)]


def put_version(spark: SparkSession, path: str, write: Callable[[str], None], *, keep: int = 2) -> str:
    """Write the next version of a table; it counts from the rename that ends it, the one before stays readable.

    A write that fails leaves the table as it was. Of earlier versions all but
    the last ``keep - 1`` are deleted.
    """
    store, at = _store(spark, path)
    before = versions(spark, path)
    number = 1 + int(VERSION.fullmatch(before[-1].rsplit("/", 1)[1]).group(1)) if before else 0
    name = f"v{number:012d}-{uuid4().hex}"
    try:
        write(f"{path}/.{name}")
        if not store.rename(at(f"{path}/.{name}"), at(f"{path}/{name}")):
            raise OSError(f"could not put {path}/{name} in place")
    finally:
        store.delete(at(f"{path}/.{name}"), True)
    for old in before[: max(0, len(before) + 1 - keep)]:
        store.delete(at(old), True)
    return f"{path}/{name}"


# ---------------------------------------------------------------- files from tasks


@dataclass
class _Written(WriterCommitMessage):
    files: list


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


class _FileWriter(DataSourceWriter):
    """Rows ``name, content`` as files: below a staging folder until the job commits."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].rstrip("/")
        self.stage = f"{self.folder}/.stage-{uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        task = TaskContext.get()
        own = f"{self.stage}/{task.partitionId()}-{task.taskAttemptId()}"
        store, root = _opened(own)
        store.create_dir(root, recursive=True)
        files = []
        for name, content in iterator:
            if not name or "/" in name:
                raise ValueError(f"{name!r} is not a file name")
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(bytes(content or b""))
            files.append((f"{own}/{name}", name))
        return _Written(files)

    def commit(self, messages: list) -> None:
        store, root = _opened(self.folder)

        def place(item: tuple[str, str]) -> None:
            store.move(_opened(item[0])[1], f"{root}/{item[1]}")

        with ThreadPool(16) as pool:
            pool.map(place, [f for m in messages if m is not None for f in m.files])
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = _opened(self.stage)
        if store.get_file_info(root).type == fs.FileType.Directory:
            store.delete_dir(root)


class FilesDataSource(DataSource):
    """``df.select("name", "content").write.format("files").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("content", T.BinaryType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("files of other names stay: write with mode('append')")
        return _FileWriter(self.options)


def save_files(files: DataFrame, folder: str) -> None:
    """Write ``name, content`` rows as files of a folder; a job that fails leaves none of them there."""
    files.sparkSession.dataSource.register(FilesDataSource)
    files.select("name", "content").write.format("files").mode("append").save(folder)
