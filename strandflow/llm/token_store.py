"""Token ids on disk, found by document key through minimal perfect hash indexes.

Layout of a store (a folder all executors see):

* ``shard-*.tok``  raw ids, little-endian, two bytes each where the vocabulary
  fits and four otherwise, documents in ascending key order, nothing between.
* ``shard-*.idx``  header, pilot of every hash bucket, then one slot per distinct
  key: fingerprint, first document and number of documents with that key; then
  the start of every document in the shard and the total.
* ``manifest``     Parquet, one row per shard: files, key range, counts, and the
  ids in all shards before it. Only files it names belong to the store, so what a
  lost or repeated task has left is never read.

The index holds no keys. A key hashes to a bucket, the bucket's pilot sends it
to its slot, and the stored fingerprint tells (but for one strange key in 2^32)
whether the key is there: constant time whatever the shard's size.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandflow.llm.common import new_folder, open_files, shuffle_partitions, slices
from strandflow.llm.tokens import encoder, with_end

#: Keys per bucket of the perfect hash.
BUCKET_KEYS = 4
MANIFEST = "shard long, tok string, idx string, low long, high long, n_docs long, n_tokens long"
ENTRIES = "doc_id long, start long, n_tokens long, ids_crc32 long"


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for shift, by in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """Sends ``n`` known keys to the slots 0 to n - 1, one each.

    Keys fall into buckets. Large buckets come first; each gets the first pilot
    under which its keys land on free, different slots. A bucket of one key is
    given a slot outright: its pilot is minus one minus the slot.
    """

    def __init__(self, n: int, pilots: np.ndarray):
        self.n, self.pilots = n, pilots

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        n = len(keys)
        buckets = max(1, -(-n // BUCKET_KEYS))
        pilots = np.zeros(buckets, dtype=np.int32)
        hashed = mix(keys.astype(np.int64).view(np.uint64))
        bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        size = np.bincount(bucket, minlength=buckets)
        first = np.cumsum(size) - size
        free = np.ones(n, dtype=bool)
        many = [b for b in np.argsort(-size, kind="stable").tolist() if size[b] > 1]
        for b in many:
            own = hashed[order[first[b] : first[b] + size[b]]]
            pilot = 0
            while True:
                tried = np.arange(pilot, pilot + 64, dtype=np.uint64)
                slots = np.sort(cls.slots(own[None, :], tried[:, None], n), axis=1)
                good = free[slots].all(axis=1) & (np.diff(slots, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    pilots[b] = pilot + k
                    free[slots[k]] = False
                    break
                pilot += 64
        single = np.flatnonzero(size == 1)
        pilots[single] = -1 - np.flatnonzero(free)
        return cls(n, pilots)

    @staticmethod
    def slots(hashed: np.ndarray, pilot: np.ndarray, n: int) -> np.ndarray:
        return (mix(hashed ^ mix(pilot + np.uint64(1))) % np.uint64(n)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        hashed = mix(keys.astype(np.int64).view(np.uint64))
        pilot = self.pilots[(hashed % np.uint64(len(self.pilots))).astype(np.int64)].astype(np.int64)
        sent = self.slots(hashed, np.maximum(pilot, 0).astype(np.uint64), max(self.n, 1))
        return np.where(pilot < 0, -1 - pilot, sent)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")


def index_bytes(keys: np.ndarray, starts: np.ndarray, width: int) -> bytes:
    """The index of documents with ascending ``keys``; a NULL key is not indexed and sorts first."""
    nulls = int(np.isnan(keys.astype(float)).sum()) if keys.dtype == object else 0
    own, first, count = np.unique(keys[nulls:].astype(np.int64), return_index=True, return_counts=True)
    hashed = PerfectHash.build(own) if len(own) else PerfectHash(0, np.zeros(1, dtype=np.int32))
    slot = hashed(own) if len(own) else np.zeros(0, dtype=np.int64)
    table = np.zeros(len(own), dtype=[("mark", "<u4"), ("first", "<u4"), ("count", "<u4")])
    table["mark"][slot], table["first"][slot], table["count"][slot] = fingerprints(own), first + nulls, count
    head = json.dumps({"width": width, "keys": len(own), "nulls": nulls, "docs": len(starts) - 1, "pilots": len(hashed.pilots)}).encode()
    return head.ljust(128) + hashed.pilots.astype("<i4").tobytes() + table.tobytes() + starts.astype("<u8").tobytes()


class ShardIndex:
    """A read index: document numbers of keys, and where documents lie."""

    def __init__(self, raw: bytes):
        self.head = h = json.loads(raw[:128])
        at = 128
        self.hash = PerfectHash(h["keys"], np.frombuffer(raw, "<i4", h["pilots"], at))
        at += 4 * h["pilots"]
        self.table = np.frombuffer(raw, [("mark", "<u4"), ("first", "<u4"), ("count", "<u4")], h["keys"], at)
        at += 12 * h["keys"]
        self.starts = np.frombuffer(raw, "<u8", h["docs"] + 1, at).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key (0: the key is not there)."""
        if not self.head["keys"]:
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        row = self.table[self.hash(keys)]
        there = row["mark"] == fingerprints(keys)
        return row["first"].astype(np.int64), np.where(there, row["count"], 0).astype(np.int64)


def write_store(
    docs: DataFrame, folder: str, *, tokenizer: str = "byte_bpe_50k.json", end: int = 2, shards: int | None = None
) -> DataFrame:
    """Write ``doc_id, text`` as a token store and return its manifest.

    A NULL text is empty. Rows under one key lie next to each other, texts in
    hash order; rows with a NULL key come first and have no index entry. An empty
    table gives a store without shards. Documents go to shards by key range, so
    a shard holds about as many documents as any other.
    """
    spark = docs.sparkSession
    n = shards or shuffle_partitions(spark)
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        files, root = open_files(folder)
        name = f"{root}/shard-{shard:06d}-{uuid.uuid4().hex}"
        enc = encoder(tokenizer)
        dtype = np.dtype("<u2") if enc.tok.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        keys, starts, out, total = [], [np.zeros(1, dtype=np.int64)], None, 0
        for batch in batches:
            keys.extend(batch.column(0).to_pylist())
            for _, texts in slices(batch.column(1)):
                ids, cuts = with_end(*enc.encode(texts), end)
                if out is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(name + ".tok")
                out.write(ids.astype(dtype).tobytes())
                starts.append(cuts[1:] + total)
                total += int(cuts[-1])
        if out is None:
            return
        out.close()
        known = [k for k in keys if k is not None]
        key_array = np.array(known, dtype=np.int64) if len(known) == len(keys) else np.array([np.nan if k is None else k for k in keys], dtype=object)
        with files.open_output_stream(name + ".idx") as f:
            f.write(index_bytes(key_array, np.concatenate(starts), dtype.itemsize))
        row = {"shard": shard, "tok": name + ".tok", "idx": name + ".idx", "low": min(known, default=None), "high": max(known, default=None), "n_docs": len(keys), "n_tokens": total}
        yield pa.RecordBatch.from_pylist([row], schema=MANIFEST_ARROW)

    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return read_manifest(spark, folder)


MANIFEST_ARROW = pa.schema([("shard", pa.int64()), ("tok", pa.string()), ("idx", pa.string()), ("low", pa.int64()), ("high", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard; ``before`` counts the ids of all shards before it."""
    shards = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))


class Shards:
    """Opens the shards of a store by key, the last few kept open. ``rows`` is the manifest."""

    def __init__(self, folder: str, rows: list[dict], keep: int = 2):
        self.files, _ = open_files(folder)
        self.rows = sorted(rows, key=lambda r: r["shard"])
        self.keyed = [r for r in self.rows if r["low"] is not None]
        self.lows = np.array([r["low"] for r in self.keyed], dtype=np.int64)
        self.open: dict[int, tuple] = {}
        self.keep = keep

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The shard (its place among those with keys) that may hold each key, or -1."""
        return np.searchsorted(self.lows, keys, side="right") - 1

    def get(self, row: dict) -> tuple[ShardIndex, pa.NativeFile]:
        if row["shard"] not in self.open:
            while len(self.open) >= self.keep:
                self.open.pop(next(iter(self.open)))[1].close()
            with self.files.open_input_file(row["idx"]) as f:
                index = ShardIndex(f.read())
            self.open[row["shard"]] = index, self.files.open_input_file(row["tok"])
        return self.open[row["shard"]]

    def ids(self, row: dict, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(start in the shard, ids) of each document number; neighbours are read at once."""
        index, file = self.get(row)
        width = index.head["width"]
        at = 0
        while at < len(docs):
            to = at + 1
            while to < len(docs) and docs[to] == docs[to - 1] + 1 and index.starts[docs[to] + 1] - index.starts[docs[at]] < 1 << 21:
                to += 1
            low, high = index.starts[docs[at]], index.starts[docs[to - 1] + 1]
            raw = np.frombuffer(file.read_at(int(high - low) * width, int(low) * width), f"<u{width}")
            for d in docs[at:to]:
                yield int(index.starts[d]), raw[index.starts[d] - low : index.starts[d + 1] - low]
            at = to


def lookup(keys: DataFrame, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document stored under the keys of column ``doc_id``.

    Each distinct key is asked once; a NULL key asks for the rows stored without
    one; absent keys give no row. Keys are range-partitioned, so a task opens few
    shards and reads them forwards. Each task takes the manifest from a broadcast
    of one short row per shard.
    """
    spark = keys.sparkSession
    rows = [r.asDict() for r in read_manifest(spark, folder).collect()]  # one row per shard
    shards = spark.sparkContext.broadcast(rows)
    asked = (
        keys.select(F.col("doc_id").cast("long").alias("doc_id"))
        .distinct()
        .repartitionByRange(max(1, len(rows)), F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = Shards(folder, shards.value)
        for batch in batches:
            column = batch.column(0)
            own = np.asarray(column.drop_null(), dtype=np.int64)
            if column.null_count:
                for row in store.rows:
                    nulls = store.get(row)[0].head["nulls"]
                    if nulls:
                        yield entries(store, row, [None] * nulls, np.arange(nulls))
                    if row["low"] is not None:
                        break
            place = store.of(own)
            for p in np.unique(place[place >= 0]).tolist():
                row, mine = store.keyed[p], own[place == p]
                first, count = store.get(row)[0].find(mine)
                docs = np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())
                if len(docs):
                    yield entries(store, row, np.repeat(mine, count).tolist(), docs)

    return asked.mapInArrow(read, ENTRIES)


def entries(store: Shards, row: dict, keys: list, docs: np.ndarray) -> pa.RecordBatch:
    found = [(start + row["before"], len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for start, ids in store.ids(row, docs)]
    start, n, crc = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, start, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def get(spark: SparkSession, folder: str, key: int) -> list[list[int]]:
    """The id lists stored under one key, read from the driver: one index, one range."""
    store = Shards(folder, [r.asDict() for r in read_manifest(spark, folder).collect()])
    own = np.array([key], dtype=np.int64)
    place = int(store.of(own)[0])
    if place < 0:
        return []
    row = store.keyed[place]
    first, count = store.get(row)[0].find(own)
    return [ids.tolist() for _, ids in store.ids(row, first[0] + np.arange(count[0]))]


def store_documents(docs: DataFrame) -> DataFrame:
    """Write all documents, then read all their keys back through the index."""
    folder = new_folder(docs.sparkSession, "tokens")
    write_store(docs, folder)
    return lookup(docs, folder)
