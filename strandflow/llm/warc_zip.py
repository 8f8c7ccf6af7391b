"""Web pages as WARC records in ZIP packages, read by byte ranges.

Each task writes one package: a ZIP whose members are *stored*, so a record
keeps an address of its own in the package:

* ``archive/data.warc.gz``  one gzip member per WARC record,
* ``indexes/index.cdxj``    per record its key, offset and length in the member,
* ``datapackage.json``      names and sizes.

The reader never unpacks a package. It fetches the tail, finds the end of the
central directory (and its ZIP64 form), parses the directory, locates the two
members behind their local headers, and then reads the index and the ranges of
the records it wants. A package counts only if the manifest names it, so the
leavings of lost or repeated tasks are never read.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.common import new_folder, open_files

#: Payloads shorter than this are always written out.
LEAST_SHARED = 100
ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "package string, n_records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Bytes read at once where records lie next to each other.
RANGE = 8 << 20


# --- records -------------------------------------------------------------


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC 1.1 record: a response with its payload, or a revisit that names the response."""
    revisit = first is not None
    body = b"" if revisit else payload
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "WARC-Payload-Length": len(payload),
        "Content-Type": "text/html; charset=utf-8",
        "Content-Length": len(body),
    }
    if revisit:
        head["WARC-Profile"] = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        head["WARC-Refers-To"] = f"<urn:page:{first}>"
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode() + body + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of one record; a response's digest and length are computed from its payload."""
    end = raw.index(b"\r\n\r\n")
    version, *lines = raw[:end].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"a record starts with {version[:20]!r}")
    head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    payload = raw[end + 4 : end + 4 + int(head["Content-Length"])]
    key = head["WARC-Record-ID"][len("<urn:page:") : -1]
    out = {"page_id": int(key) if key else None, "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"], "refers_to": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = int(head["WARC-Refers-To"][len("<urn:page:") : -1])
        return out | {"payload_digest": head["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": int(head["WARC-Payload-Length"]), "payload": None}
    digest = hashlib.sha256(payload).hexdigest()
    if head["WARC-Payload-Digest"] != f"sha256:{digest}":
        raise ValueError(f"page {key}: the payload does not have the digest of its record")
    return out | {"payload_digest": digest, "payload_bytes": len(payload), "payload": payload}


# --- packages ------------------------------------------------------------


class Forward:
    """A stream that cannot go back, as object stores give for writing."""

    def __init__(self, stream):
        self.stream, self.at = stream, 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        self.at += len(data)
        return len(data)

    def flush(self) -> None:
        pass


class PackageWriter:
    """Streams records into the archive member and keeps only their index lines."""

    def __init__(self, stream):
        self.out = Forward(stream)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(ARCHIVE, "w", force_zip64=True)
        self.at, self.lines = 0, []

    def add(self, page_id: int | None, raw: bytes, kind: str) -> None:
        packed = gzip.compress(raw, compresslevel=6, mtime=0)
        self.member.write(packed)
        self.lines.append(json.dumps({"page_id": page_id, "type": kind, "offset": self.at, "length": len(packed)}, separators=(",", ":")))
        self.at += len(packed)

    def close(self) -> None:
        self.member.close()
        with self.zip.open(INDEX, "w", force_zip64=True) as f:
            f.write("\n".join(self.lines).encode())
        self.zip.writestr("datapackage.json", json.dumps({"profile": "data-package", "resources": [{"path": ARCHIVE, "bytes": self.at, "records": len(self.lines)}, {"path": INDEX}]}))
        self.zip.close()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    stored: int
    header: int


class PackageReader:
    """Finds and reads parts of a ZIP through ``read_at(length, offset)`` alone."""

    def __init__(self, read_at, size: int):
        self.read_at, self.size = read_at, size
        self.members = {m.name: m for m in self.directory()}

    def end(self) -> tuple[int, int, int]:
        """(entries, bytes, offset) of the central directory."""
        # The end record has 22 bytes and a comment of up to 65,535.
        length = min(self.size, 22 + 0xFFFF)
        tail = self.read_at(length, self.size - length)
        at = len(tail)
        while (at := tail.rfind(b"PK\x05\x06", 0, at)) >= 0:
            if at + 22 <= len(tail) and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] == len(tail):
                break
        if at < 0:
            raise ValueError("not a ZIP package: no end of central directory")
        n, length, offset = struct.unpack_from("<HII", tail, at + 10)
        place = self.size - len(tail) + at
        if 0xFFFF == n or 0xFFFFFFFF in (length, offset):
            magic, _, where, _ = struct.unpack("<4sIQI", self.read_at(20, place - 20))
            if magic != b"PK\x06\x07":
                raise ValueError("the ZIP64 locator is missing")
            big = self.read_at(56, where)
            if big[:4] != b"PK\x06\x06":
                raise ValueError("the ZIP64 end of central directory is missing")
            n, length, offset = struct.unpack_from("<QQQ", big, 32)
        return n, length, offset

    def directory(self) -> Iterator[Member]:
        n, length, offset = self.end()
        raw, at = self.read_at(length, offset), 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("the central directory is damaged")
            method, = struct.unpack_from("<H", raw, at + 10)
            stored, size, names, extras, comment = struct.unpack_from("<IIHHH", raw, at + 20)
            header, = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + names].decode()
            extra = raw[at + 46 + names : at + 46 + names + extras]
            # ZIP64 holds, in this order, those of the three that did not fit.
            wide, spot = {}, 0
            while spot + 4 <= len(extra):
                tag, n_bytes = struct.unpack_from("<HH", extra, spot)
                if tag == 1:
                    full = [k for k, v in (("size", size), ("stored", stored), ("header", header)) if v == 0xFFFFFFFF]
                    wide = dict(zip(full, struct.unpack_from(f"<{n_bytes // 8}Q", extra, spot + 4)))
                spot += 4 + n_bytes
            yield Member(name, method, wide.get("size", size), wide.get("stored", stored), wide.get("header", header))
            at += 46 + names + extras + comment

    def start(self, name: str) -> int:
        """Where a stored member's bytes begin: behind its local header, whose extra field may differ."""
        m = self.members[name]
        if m.method:
            raise ValueError(f"{name} is compressed and cannot be read by ranges")
        head = self.read_at(30, m.header)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name} has no local header")
        names, extras = struct.unpack_from("<HH", head, 26)
        return m.header + 30 + names + extras

    def read(self, name: str) -> bytes:
        return self.read_at(self.members[name].size, self.start(name))

    def index(self) -> list[dict]:
        return [json.loads(x) for x in self.read(INDEX).decode().split("\n") if x]

    def records(self, entries: list[dict]) -> Iterator[dict]:
        """Records at index entries in ascending offset; neighbours come in one range."""
        base, i = self.start(ARCHIVE), 0
        while i < len(entries):
            j, low = i + 1, entries[i]["offset"]
            while j < len(entries) and entries[j]["offset"] == entries[j - 1]["offset"] + entries[j - 1]["length"] and entries[j]["offset"] + entries[j]["length"] - low <= RANGE:
                j += 1
            raw = self.read_at(entries[j - 1]["offset"] + entries[j - 1]["length"] - low, base + low)
            for e in entries[i:j]:
                yield parse_record(gzip.decompress(raw[e["offset"] - low : e["offset"] - low + e["length"]]))
            i = j


# --- jobs ----------------------------------------------------------------


def with_first(pages: DataFrame, least: int = LEAST_SHARED) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` is set on rows that repeat an earlier payload.

    Of rows with equal payloads of at least ``least`` bytes that with the
    smallest id comes first; rows repeated under that id all stay responses.
    A NULL html is empty; a NULL id comes after all others and, where no other
    row has the payload, is a response.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    own = own.withColumn("digest", F.sha2("payload", 256))
    # Counted before they meet, so a payload that a third of the pages share is one row here.
    first = (
        own.filter(F.length("payload") >= least)
        .groupBy(F.col("digest").alias("digest_"))
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    joined = own.join(first, F.col("digest") == F.col("digest_"), "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))


def write_packages(pages: DataFrame, folder: str) -> DataFrame:
    """Write ``page_id, url, html`` as one package per task; returns the manifest."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = None
        for batch in batches:
            for row in range(batch.num_rows):
                page_id, url, payload, digest, first = (batch.column(i)[row].as_py() for i in range(5))
                if writer is None:
                    files, root = open_files(folder)
                    files.create_dir(root, recursive=True)
                    package = f"{root}/pages-{uuid.uuid4().hex}.wacz"
                    stream = files.open_output_stream(package)
                    writer = PackageWriter(stream)
                writer.add(page_id, record(page_id, url, payload, digest, first), "response" if first is None else "revisit")
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pylist(
                [{"package": package, "n_records": len(writer.lines), "bytes": writer.out.at}],
                schema=pa.schema([("package", pa.string()), ("n_records", pa.int64()), ("bytes", pa.int64())]),
            )

    with_first(pages).mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(pages.sparkSession, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_packages(spark: SparkSession, folder: str, *, payloads: bool = True) -> DataFrame:
    """Every record of a folder of packages, read by ranges; a revisit has no payload."""
    packages = manifest(spark, folder)
    n = max(1, packages.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = open_files(folder)
        kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.open_input_file(path) as f:
                    package = PackageReader(f.read_at, f.size())
                    rows, held = [], 0
                    for r in package.records(package.index()):
                        held += 200 + (len(r["payload"] or b"") if payloads else 0)
                        rows.append(r if payloads else r | {"payload": None})
                        if held > RANGE:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return packages.select("package").repartition(n).mapInArrow(read, RECORD)


def with_payloads(records: DataFrame) -> DataFrame:
    """Records with revisits resolved: each carries the payload of the response it names."""
    given = records.filter("record_type = 'response'").select(F.col("page_id").alias("to_"), F.col("payload").alias("given_")).dropDuplicates(["to_"])
    out = records.join(given, F.col("refers_to") == F.col("to_"), "left")
    return out.select(*[c for c in records.columns if c != "payload"], F.coalesce("payload", "given_").alias("payload"))


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, read all records back: the digest columns of every page."""
    folder = new_folder(pages.sparkSession, "packages")
    write_packages(pages, folder)
    return read_packages(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {LEAST_SHARED} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
