"""Near duplicates by SimHash, compared bit-sliced.

A fingerprint has 64 bits; two link where at most ``RADIUS`` differ. The bits
are cut into six bands: two fingerprints at distance four or less agree on at
least two bands, so only those that share one of the fifteen pairs of bands are
compared. Within such a bucket the fingerprints stand as bit planes, 64 members
to a machine word: plane *p* holds bit *p* of all. A query goes through the
planes, adds each plane of differences to saturating carry-save counters, and
leaves a word (a block of 64 members) as soon as all of it is beyond the radius.

Buckets larger than ``BLOCK`` are cut into blocks, and each pair of blocks is a
task of its own, so no bucket is gathered whole. A task reports, per member,
only the smallest member it is linked to by its own comparisons: a forest, never
all pairs, and no link between different fingerprints is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, shuffle_partitions, slices, written
from strandflow.operators.graph import connected_components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: (first bit, bits) of the bands; the radius plus two of them.
BANDS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
#: Members of a bucket that meet in one task.
BLOCK = 4096
#: (query, word) comparisons worked on at once: at most 64 times as many links are held.
CHUNK = 1 << 13
#: Rows of whole buckets that are compared together.
ROWS = 1 << 15
#: Planes between two looks for words that are out of reach.
LOOK = 8


# --- fingerprints ----------------------------------------------------------


def shingle_hashes(text: str) -> np.ndarray:
    """XXH64 of each run of four words, or of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(line, SEED)], dtype=np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    end = np.cumsum(size) - 1
    first = (end - size + 1)[: len(words) - SHINGLE + 1].tolist()
    last = end[SHINGLE - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(line[a:b], SEED) for a, b in zip(first, last)), dtype=np.uint64, count=len(first))


def simhash(hashes: np.ndarray) -> int:
    """A bit is set if it is in over half of the hashes."""
    count = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[a : a + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """``doc_id, text_, fp`` of every row (hash of the text, ``fp`` as a signed long); texts without words have ``fp`` 0."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                fp = np.array([simhash(shingle_hashes(t)) for t in texts], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), batch.column(2).slice(row, len(texts)), pa.array(fp)], names=["doc_id", "text_", "fp"]
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_"))
    return own.mapInArrow(compute, "doc_id long, text_ long, fp long")


# --- bit-sliced comparison ---------------------------------------------------


class Planes:
    """Fingerprints stored vertically; every group starts at a new word."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """``group`` ascends; members of one group are compared."""
        n = len(fps)
        self.fps = fps
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([starts, [n]]))
        words = -(-size // 64)
        self.first_word = np.repeat(np.cumsum(words) - words, size)
        self.end_word = self.first_word + np.repeat(words, size)
        rank = np.arange(n) - np.repeat(starts, size)
        self.word = self.first_word + rank // 64
        self.lane = (rank % 64).astype(np.uint64)
        total = int(words.sum())
        self.member = np.full(total * 64, -1, dtype=np.int64)
        self.member[self.word * 64 + self.lane.astype(np.int64)] = np.arange(n)
        lanes = np.zeros(total * 64, dtype=np.uint64)
        lanes[self.member >= 0] = fps
        filled = (self.member >= 0).reshape(total, 64)
        self.valid = np.packbits(filled, axis=1, bitorder="little").view("<u8").ravel()
        lanes = lanes.reshape(total, 64)
        self.planes = np.empty((64, total), dtype=np.uint64)
        for p in range(64):
            bit = ((lanes >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
            self.planes[p] = np.packbits(bit, axis=1, bitorder="little").view("<u8").ravel()

    def near(self, query: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Member pairs within the radius: each query against the 64 members of its word."""
        alive = np.arange(len(query))
        fp, at = self.fps[query], word
        ones = np.zeros(len(query), dtype=np.uint64)
        twos, fours, over = ones.copy(), ones.copy(), ones.copy()
        for p in range(64):
            differ = self.planes[p][at] ^ (np.uint64(0) - ((fp >> np.uint64(p)) & np.uint64(1)))
            carry = ones & differ
            ones ^= differ
            carry2 = twos & carry
            twos ^= carry
            over |= fours & carry2  # eight or more, for good
            fours ^= carry2
            if p % LOOK == LOOK - 1:
                # Five, six or seven: fours with ones or twos.
                beyond = over | fours & (ones | twos)
                stay = np.flatnonzero(~beyond & self.valid[at])
                if len(stay) < len(alive):
                    alive, fp, at = alive[stay], fp[stay], at[stay]
                    ones, twos, fours, over = ones[stay], twos[stay], fours[stay], over[stay]
                if not len(alive):
                    break
        if not len(alive):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        close = ~(over | fours & (ones | twos)) & self.valid[at]
        bits = np.unpackbits(close.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(bits)
        return query[alive[row]], self.member[at[row] * 64 + lane]


def smallest_linked(planes: Planes, allowed=None) -> np.ndarray:
    """Per member, the smallest member it is joined to through links found here.

    ``allowed(a, b)`` says which members may be compared (blocks with blocks).
    """
    n = len(planes.fps)
    root = np.arange(n)
    count = planes.end_word - planes.word
    end = np.cumsum(count)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + CHUNK, side="right")))
        own = count[at:to]
        query = np.repeat(np.arange(at, to), own)
        word = np.repeat(planes.word[at:to] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        a, b = planes.near(query, word)
        keep = a < b if allowed is None else (a < b) & allowed(a, b)
        join_roots(root, a[keep], b[keep])
        at = to
    return settled(root)


def settled(root: np.ndarray) -> np.ndarray:
    while (root[root] != root).any():
        root[:] = root[root]
    return root


def join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the trees of linked members; ``root`` always points to a smaller member."""
    while len(a):
        settled(root)
        a, b = root[a], root[b]
        differ = a != b
        a, b = np.minimum(a[differ], b[differ]), np.maximum(a[differ], b[differ])
        if not len(a):
            return
        pairs = np.unique(a * len(root) + b)
        a, b = pairs // len(root), pairs % len(root)
        np.minimum.at(root, b, a)


# --- jobs ----------------------------------------------------------------


def bucket_keys() -> Column:
    """The fifteen keys of ``fp``: which two bands, and their bits."""
    keys = []
    for number, (x, y) in enumerate(combinations(BANDS, 2)):
        bits = [F.shiftrightunsigned("fp", start).bitwiseAND((1 << width) - 1) for start, width in (x, y)]
        keys.append(F.lit(number << 22).bitwiseOR(F.shiftleft(bits[0], 11)).bitwiseOR(bits[1]))
    return F.array(*keys)


def links(prints: DataFrame) -> DataFrame:
    """``src, dst``: a forest that joins all distinct ``fp`` that link, directly or through others.

    Keys that only one fingerprint has are dropped after a count; a bucket of
    more than ``BLOCK`` is dealt to pairs of blocks.
    """
    spark = prints.sparkSession
    keyed = prints.select("fp", F.explode(bucket_keys()).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks).cast("int")
    meet = (
        keyed.join(sizes, "key")
        .select("key", "fp", own.alias("own"), blocks.alias("blocks"))
        .select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "fp")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 5), dtype=np.int64)
        for batch in batches:
            new = np.stack([np.asarray(c.cast(pa.int64()) if c.type != pa.bool_() else c.cast(pa.int8()).cast(pa.int64())) for c in batch.columns], axis=1)
            held = np.concatenate([held, new])
            # The last group may go on in the next batch.
            cut = int(np.flatnonzero((held[:, :3] != held[-1, :3]).any(axis=1)).max(initial=-1)) + 1
            if cut >= ROWS:
                yield forest(held[:cut])
                held = held[cut:]
        if len(held):
            yield forest(held)

    dealt = meet.repartition(shuffle_partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return dealt.mapInArrow(compare, "src long, dst long")


def forest(rows: np.ndarray) -> pa.RecordBatch:
    """The links within whole groups: (key, i, j, second, fp) rows in group order."""
    change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    group = np.concatenate([[0], np.cumsum(change)])
    fps, second, across = rows[:, 4], rows[:, 3] > 0, rows[:, 1] != rows[:, 2]
    planes = Planes(fps.view(np.uint64), group)
    # Two blocks meet for the links between them; those within are their own pair's.
    root = smallest_linked(planes, lambda a, b: ~across[a] | (second[a] != second[b]))
    other = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(fps[other]), pa.array(fps[root[other]])], names=["src", "dst"])


def labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, text_, fp`` of every row, and ``fp, part, least`` of every fingerprint.

    Fingerprints that links join, directly or through others, have the same
    ``part``. ``least`` is the first row of a fingerprint, as (nameless, doc_id,
    text_): by id, NULL ids last, then by the hash of the text.
    """
    marked = written(fingerprinted(docs), "fingerprints")
    # Copies, however many, are one row from here on.
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_")
    prints = written(marked.groupBy("fp").agg(F.min(row).alias("least")), "prints")
    parts = connected_components(links(prints))
    return marked, prints.join(parts, prints["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"), "least")


def grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` of every row.

    ``component_id`` is the smallest id that links reach; equal fingerprints
    link, also those of texts without words (NULL, empty). NULL ids belong to
    groups but name none: a group of NULL ids only has a NULL ``component_id``.
    """
    marked, prints = labelled(docs)
    named = prints.groupBy("part").agg(F.min("least.doc_id").alias("component_id"))
    by_print = prints.join(named, "part").select(F.col("fp").alias("fp_"), "component_id")
    return marked.join(by_print, F.col("fp") == F.col("fp_")).select("doc_id", "fp", "component_id")


def components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` (16 hexadecimal digits) ``, component_id``."""
    return grouped(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of every group, unchanged: that with the smallest id, NULL ids last, then the smallest hash of the text.

    Documents are told apart by id and text: different texts under one id, or
    without one, go or stay each by its own group. Rows repeated with the same
    id and text stay once.
    """
    named, own, other = fresh(docs, "kept_id"), fresh(docs, "text_"), fresh(docs, "kept_text")
    _, prints = labelled(docs)
    first = prints.groupBy("part").agg(F.min("least").alias("least"))
    kept = first.select(F.col("least.doc_id").alias(named), F.col("least.text_").alias(other))
    rows = docs.withColumn(own, F.xxhash64("text"))
    same = rows["doc_id"].cast("long").eqNullSafe(kept[named]) & (rows[own] == kept[other])
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)
