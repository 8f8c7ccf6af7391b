"""Hierarchical best-fit packing of token pieces into sequences of bounded length.

Round 0 packs each partition's pieces best-fit, longest first. Nearly full bins
are final. The others become items of the next round, a bin with all its pieces
being one item, on fewer partitions, and so up a tree until one partition has
seen what is left or a round joins nothing any more. A bin holds at most
``capacity`` pieces, so its members travel in its row; a task never holds more
than about ``task_items`` bins, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import shuffle_partitions, slices, written
from strandflow.llm.tokens import encoder, with_end

CAPACITY = 1024
#: Bins and items that one task takes; beyond it the round has more tasks.
TASK_ITEMS = 100_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
BIN = f"size int, members array<struct<{PIECE.replace(' long', ':long').replace(' int', ':int')}>>"


def cut_pieces(docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: documents as ids with ``end``, cut only where longer than ``capacity``.

    A long document's first piece takes what is over a multiple of ``capacity``,
    so all its other pieces fill a sequence. A NULL text is empty (one id).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                ids, cuts = with_end(*enc.encode(texts), end)
                total = np.diff(cuts)
                n = -(-total // capacity)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = np.repeat((total - 1) % capacity + 1, n)
                start = np.where(piece > 0, first + (piece - 1) * capacity, 0)
                length = np.where(piece > 0, capacity, first)
                at = np.repeat(cuts[:-1], n) + start
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
                keys = batch.column(0).slice(row, len(texts)).take(pa.array(np.repeat(np.arange(len(texts)), n)))
                yield pa.RecordBatch.from_arrays(
                    [keys, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(cut, PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item: longest items first, each into the fullest bin that still takes it."""
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), dtype=np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0  # bit s: some bin has s ids of room
    bins = 0
    for item, size in zip(order.tolist(), sizes[order].tolist()):
        fit = spaces >> size
        if fit:
            room = size + (fit & -fit).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                spaces ^= 1 << room
        else:
            room, b = capacity, bins
            bins += 1
        out[item] = b
        left = room - size
        if left:
            open_bins[left].append(b)
            spaces |= 1 << left
    return out


def pack_bins(table: pa.Table, capacity: int) -> pa.RecordBatch:
    """One bin per row of the result, with the members of the items put into it."""
    sizes = np.asarray(table.column("size"), dtype=np.int64)
    lists = table.column("members").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0)
    starts, counts = np.asarray(lists.offsets, dtype=np.int64)[:-1], np.diff(np.asarray(lists.offsets, dtype=np.int64))
    where = best_fit(sizes, capacity)
    order = np.argsort(where, kind="stable")
    n_bins = int(where.max()) + 1
    count = counts[order]
    flat = np.repeat(starts[order] - np.cumsum(count) + count, count) + np.arange(count.sum())
    per_bin = np.bincount(where, weights=counts, minlength=n_bins).astype(np.int64)
    members = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_bin)]), pa.int32()), lists.values.take(pa.array(flat)))
    fill = np.bincount(where, weights=sizes, minlength=n_bins).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(fill), members], names=["size", "members"])


def pack_round(items: DataFrame, capacity: int) -> DataFrame:
    """Best-fit within each partition, in blocks of ``TASK_ITEMS`` items."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            kept.append(batch)
            n += batch.num_rows
            if n >= TASK_ITEMS:
                yield pack_bins(pa.Table.from_batches(kept), capacity)
                kept, n = [], 0
        if n:
            yield pack_bins(pa.Table.from_batches(kept), capacity)

    return items.mapInArrow(pack, BIN)


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, slack: int = 4, fan_in: int = 8) -> DataFrame:
    """Place pieces of at most ``capacity`` ids into sequences: adds ``sequence_id, offset``.

    A bin with at most ``slack`` ids of room is final. Pieces that fill a
    sequence alone never enter a round. Pieces in a sequence lie without gaps
    from offset 0. An empty table gives an empty table.
    """
    spark = pieces.sparkSession
    item = pieces.select(
        F.col("length").cast("int").alias("size"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members")
    )
    items = written(item, "pieces")
    done = items.filter(F.col("size") >= capacity)
    left = items.filter(F.col("size") < capacity)
    count = left.count()
    tasks = max(1, min(shuffle_partitions(spark), -(-count // 4096)), -(-count // TASK_ITEMS))
    while count:
        # Items are dealt evenly; which task gets which does not matter.
        bins = written(pack_round(left.repartition(tasks), capacity), "bins")
        full = bins.filter(F.col("size") >= capacity - slack)
        left = bins.filter(F.col("size") < capacity - slack)
        done = done.unionByName(full)
        before, count = count, left.count()
        joined = bins.count() < before
        if tasks == 1 or not joined:
            break
        tasks = max(1, -(-tasks // fan_in), -(-count // TASK_ITEMS))
    done = done.unionByName(left)
    return place(done.withColumn("sequence_id", F.monotonically_increasing_id()))


def place(bins: DataFrame) -> DataFrame:
    """The members of every bin as rows, with their offsets."""

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            counts = np.asarray(pc.list_value_length(lists), dtype=np.int64)
            flat = lists.flatten()
            length = np.asarray(flat.field("length"), dtype=np.int64)
            end = np.cumsum(length)
            first = np.cumsum(counts) - counts
            base = (end - length)[first] if len(first) else end
            sequence = batch.column(1).take(pa.array(np.repeat(np.arange(len(counts)), counts)))
            columns = [flat.field(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [*columns, sequence, pa.array(end - length - np.repeat(base, counts), pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return bins.select("members", "sequence_id").mapInArrow(unfold, PIECE + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame) -> DataFrame:
    """Documents as pieces, packed: one row per piece."""
    return pack(cut_pieces(docs))


def sequences(placed: DataFrame, docs: DataFrame, *, tokenizer: str = "byte_bpe_50k.json", end: int = 2) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves.

    Each document is encoded once, where its pieces meet it; a sequence gathers
    at most ``capacity`` ids. Rows that share a key must share their text.
    """
    pieces = placed.groupBy("doc_id").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["doc_id"])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            for row, own in slices(batch.column(0)):
                ids, cuts = with_end(*enc.encode(own), end)
                out = [
                    {"sequence_id": p["sequence_id"], "offset": p["offset"], "ids": ids[c + p["start"] : c + p["start"] + p["length"]].astype(np.int32)}
                    for c, places in zip(cuts.tolist(), batch.column(1).slice(row, len(own)).to_pylist())
                    for p in places
                ]
                yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))]))

    chunks = (
        texts.join(pieces, texts.doc_id.eqNullSafe(pieces.doc_id)).select("text", "pieces").mapInArrow(ids_of, "sequence_id long, offset long, ids array<int>")
    )
    return chunks.groupBy("sequence_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))
