r"""Language-model scores from a probabilistic suffix tree over words.

The tree's states are contexts, runs of up to ``DEPTH`` words. A context is a
candidate if it occurs ``LEAST_COUNT`` times, and is retained if what follows it
diverges from what follows its own suffix, by the Kullback-Leibler sum over its
counts, or if a longer retained context ends in it. A token is scored in the
longest retained context that the words before it end in, the root where there is
none:

    P(w | s) = c(s w) / (c(s) + T(s)) + g(s) P(w | suffix of s),
    g(s) = (c(s) + T(s) - sum of the c(s w) kept) / (c(s) + T(s)),

over the ``T(s)`` continuations of ``s`` that occur ``LEAST_COUNT`` times
themselves; below the root lies the base P(w) = (c + 1) / (N + V + 1). Each is a
distribution over the training tokens and one unknown token.

In logarithms a text's score is a sum over the runs in it: each adds what it gains
over its suffix, if its context is retained, and its own g, if it is retained
itself. So scoring looks up one number a run. Words of ``LEAST_SHARE`` of the
training tokens, and the most frequent runs of such words, up to ``1 / LEAST_SHARE``
of each length, are numbered and broadcast with theirs. All others keep theirs in a
table that their occurrences meet in a join, as rare words meet their counts; where
the line lies changes no result. Tables of bits of a fixed size keep most runs that are no part of the model
out of the shuffles; what they let through is not found in the join.

A rare word or run is known by 63 bits: a hash of its bytes, or of the two runs
that it is without its last and without its first word.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, give_back, pieces, remainder, written

DEPTH = 2
#: Share of the training tokens from which words are broadcast, and one by the most runs of a length that are; the others are joined.
LEAST_SHARE = 1e-6
#: Occurrences below which nothing is told of a context or a continuation, however large the corpus.
LEAST_COUNT = 5
#: Nats by which a context's counts must favour its own continuations over its suffix's.
LEAST_DIVERGENCE = 8.0
#: Counts a task holds before it adds them up and sends them on.
HELD_ROWS = 400_000
#: Bytes of text worked on at once: some 25 arrays of a number a token.
PIECE_BYTES = 3 << 19
#: Bits that tell which rare words or runs may be in the model.
BITS = 1 << 26
#: The end of a text. No word is empty.
END = ""
PARTS = "end boolean, base double, score double, n_tokens long, n_known long, rare array<struct<word:string,run:long,n:int>>"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` one after the other, A-Z in lower case, and the text each stands in."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), np.asarray(text.filter(there))


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over all rows of ``text``; the end of a text is the word ``END``. NULL reads as empty."""

    def added_up(tables: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, ends = [], 0, 0
        for batch in batches:
            ends += batch.num_rows
            for _, column, _ in pieces(batch.column(0), PIECE_BYTES):
                coded = split(column)[0].dictionary_encode()
                times = np.bincount(np.asarray(coded.indices), minlength=len(coded.dictionary))
                held.append(pa.Table.from_arrays([coded.dictionary.cast(pa.string()), pa.array(times)], names=["word", "n"]))
                n += len(held[-1])
                if n > HELD_ROWS:
                    held = [added_up(held)]
                    n = len(held[0])
                    if n > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if ends:
            held.append(pa.table({"word": pa.array([END]), "n": pa.array([ends])}))
            yield from added_up(held).to_batches(max_chunksize=50_000)
        held.clear()
        give_back()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of ``x`` (unsigned) spread over all bits: the last step of MurmurHash3."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rare_id(x: np.ndarray) -> np.ndarray:
    """Hashes as ids of rare runs: below -1, which is no run."""
    return np.minimum((x | np.uint64(1 << 63)).view(np.int64), -2)


def word_ids(words: pa.Array) -> np.ndarray:
    """Ids of rare words, none of them empty."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    at = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].astype(np.uint64)
    place = np.arange(1, len(data) + 1) - np.repeat(at[:-1] - at[0], np.diff(at))
    return rare_id(mixed(np.add.reduceat(mixed((place.astype(np.uint64) << np.uint64(8)) | data), at[:-1] - at[0])))


def run_ids(level: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Ids of rare runs of ``level`` + 2 words, from those without the last and without the first word."""
    x = mixed(before.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
    return rare_id(mixed(x + after.view(np.uint64)))


def bits_of(runs: DataFrame) -> np.ndarray:
    """A table of ``BITS`` bits with those set that the rare ids in ``run`` fall on."""
    low = F.col("run").bitwiseAND(F.lit(BITS - 1))
    slot = F.shiftright(low, 6).alias("slot")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    got = runs.filter(F.col("run") < -1).groupBy(slot).agg(F.bit_or(one).alias("bits")).toArrow()  # at most BITS / 64 rows
    out = np.zeros(BITS // 64, dtype=np.int64)
    out[np.asarray(got.column("slot"), dtype=np.int64)] = np.asarray(got.column("bits"), dtype=np.int64)
    return out.view(np.uint64)


def among(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether rare ids may be among those that ``bits`` was made of."""
    low = ids.view(np.uint64) & np.uint64(BITS - 1)
    return (bits[low >> np.uint64(6)] >> (low & np.uint64(63))) & np.uint64(1) > 0


@dataclass
class SuffixTree:
    """Numbered frequent words, and the frequent runs of two words and more by length.

    ``keys[k]`` are the ascending keys of runs of k + 2 words: the number of the run
    without its last word times ``radix(k)`` plus the number of that without its
    first; a run's number is its place. ``counts`` are those of words. ``bits[k]``
    tell which rare runs of k + 1 words may occur often enough. A run's id is its
    number, or below -1 if it is rare; -1 is none.
    """

    words: pa.Array
    total: int
    distinct: int
    counts: np.ndarray
    keys: list[np.ndarray] = field(default_factory=list)
    bits: list[np.ndarray] = field(default_factory=list)
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    def radix(self, level: int) -> int:
        return (len(self.keys[level - 1]) if level else len(self.words)) + 1

    def number(self, words: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Ids of words, -1 for those that occur too rarely, and the words as a dictionary."""
        coded = words.dictionary_encode()
        return self.ids_of(coded.dictionary)[np.asarray(coded.indices, dtype=np.int64)], coded

    def ids_of(self, words: pa.Array) -> np.ndarray:
        out = np.array(pc.fill_null(pc.index_in(words, self.words.cast(words.type)), -1), dtype=np.int64)
        rare = np.flatnonzero(out < 0)
        out[rare] = self.possible(0, word_ids(words.take(pa.array(rare))))
        return out

    def possible(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Rare ids of runs of ``level`` + 1 words, -1 for those that occur too rarely."""
        return np.where(among(self.bits[level], ids), ids, -1) if level < len(self.bits) else ids

    def extended(self, level: int, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """Ids of runs of ``level`` + 2 words, from those without the last and without the first word."""
        out = np.full(len(before), -1, dtype=np.int64)
        keys = self.keys[level]
        at = np.flatnonzero((before >= 0) & (after >= 0))
        if len(keys) and len(at):
            key = before[at] * self.radix(level) + after[at]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            out[at] = np.where(keys[place] == key, place, -1)
        at = np.flatnonzero((out < 0) & (before != -1) & (after != -1))
        out[at] = self.possible(level + 1, run_ids(level, before[at], after[at]))
        return out

    def runs(self, word: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
        """For every token and length, the id of the run that ends with it; ``start`` counts the tokens of its text before it."""
        out = [word]
        for level in range(len(self.keys)):
            out.append(self.extended(level, contexts(out[level], start, level), out[level]))
        return out

    def freeze(self, weights: DataFrame) -> None:
        """Take over what frequent runs add to a score, and which rare ones add anything; ``level, run, weight``."""
        self.base = np.log10((np.concatenate([self.counts, [0]]) + 1.0) / (self.total + self.distinct + 1.0))
        self.weights = [np.zeros(len(n) + 1) for n in (self.words, *self.keys)]
        got = weights.filter(F.col("run") >= 0).toArrow()  # at most 1 / LEAST_SHARE rows a length
        level, run, weight = (np.asarray(got.column(c)) for c in ("level", "run", "weight"))
        for k, own in enumerate(self.weights):
            own[run[level == k]] = weight[level == k]
        self.rare = bits_of(weights.filter(F.col("level") > 0))
        self.name = uuid.uuid4().hex  # workers may hold this tree as it was

    def added(self, runs: list[np.ndarray]) -> np.ndarray:
        """What the word and the frequent runs that end with every token add to its text's score."""
        out = np.where(runs[0] >= 0, self.base[np.maximum(runs[0], -1)], 0.0)
        for weight, run in zip(self.weights, runs):
            out += weight[np.maximum(run, -1)]
        return out

    def scores(self, word: np.ndarray, start: np.ndarray) -> np.ndarray:
        """What every token adds to the log10 probability of its text, without rare words and runs."""
        return self.added(self.runs(word, start))


def contexts(run: np.ndarray, start: np.ndarray, level: int) -> np.ndarray:
    """The run of ``level`` + 1 words before every token, -1 where its text has too few."""
    out = np.concatenate([[-1], run[:-1]])
    out[start <= level] = -1
    return out


TREES: dict[str, SuffixTree] = {}


def kept_tree(tree: SuffixTree) -> SuffixTree:
    """The worker's own copy of a tree; only the last one is kept."""
    if tree.name not in TREES:
        TREES.clear()
        TREES[tree.name] = tree
    return TREES[tree.name]


class Reader:
    """Tokens of a column, a few megabytes at a time, each text with its end; a long text's pieces remember the words before."""

    def __init__(self, tree: SuffixTree):
        self.tree, self.end, self.held = tree, tree.words.index(END).as_py(), np.zeros(0, dtype=np.int64)

    def read(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.DictionaryArray, np.ndarray]]:
        """(row, id, tokens before in the text, whether held over, coded words, their places) of tokens."""
        for rows, texts, ended in pieces(column, PIECE_BYTES):
            words, text = split(texts)
            number, coded = self.tree.number(words)
            held = len(self.held)
            if ended:
                # The end of text i comes after its words.
                sizes = np.bincount(text, minlength=len(texts))
                at = np.cumsum(sizes)
                place = np.arange(len(number)) + text
                full, own = np.empty(len(number) + len(texts), dtype=np.int64), np.empty(len(number) + len(texts), dtype=np.int64)
                full[place], own[place] = number, text
                full[at + np.arange(len(texts))], own[at + np.arange(len(texts))] = self.end, np.arange(len(texts))
            else:
                full, own, place = number, text.astype(np.int64), np.arange(len(number))
            full, own = np.concatenate([self.held, full]), np.concatenate([np.zeros(held, dtype=np.int64), own])
            sizes = np.bincount(own)
            start = np.arange(len(own)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield rows[own], full, start, np.arange(len(own)) < held, coded, place + held
            self.held = self.held[:0] if ended else full[-len(self.tree.keys) - 2 :]


def repeated(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Pairs once each, in order, with the sums of their ``n``."""
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, dtype=np.int64)
    return [a[first], b[first], np.add.reduceat(n, first) if len(a) else n]


def run_counts(texts: DataFrame, shared: Broadcast, least: int) -> DataFrame:
    """``a, b, n`` of the runs one word longer than the tree's that occur ``least`` times or more.

    ``a, b`` are the ids of the run without its last and without its first word; two
    numbers come as one key in ``a``, with -1 in ``b``. A run is as rare as its rarest
    part: only tokens that go on a run which may occur often enough are counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = kept_tree(shared.value)
        level = len(tree.keys)
        reader, held, n = Reader(tree), [], 0

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in repeated(*(np.concatenate(x) for x in zip(*held)))], names=["a", "b", "n"])

        for batch in batches:
            for _, word, start, old, _, _ in reader.read(batch.column(0)):
                after = tree.runs(word, start)[level]
                before = contexts(after, start, level)
                good = (before != -1) & (after != -1) & ~old
                frequent = good & (before >= 0) & (after >= 0)
                key, times = np.unique(before[frequent] * tree.radix(level) + after[frequent], return_counts=True)
                held.append([key, np.full(len(key), -1), times])
                n += len(key)
                good &= ~frequent
                held.append([before[good], after[good], np.ones(good.sum(), dtype=np.int64)])
                n += len(held[-1][0])
                if n > HELD_ROWS:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()
        held.clear()
        give_back()

    return texts.select("text").mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def line(counts: DataFrame, often: int, least_share: float, least_count: int) -> int:
    """The least count of at most ``1 / least_share`` rows of ``counts``; no higher than ``often``."""
    most = 1 / least_share if least_share else float("inf")
    each = counts.select(F.least("n", F.lit(often)).alias("n")).filter(F.col("n") >= least_count).groupBy("n").count().orderBy(F.desc("n")).collect()  # no more rows than ``often``
    room, out = most, often
    for row in each:
        room -= row["count"]
        if room < 0:
            break
        out = row["n"]
    return out


def numbered_words(counts: DataFrame, shared: Broadcast) -> DataFrame:
    """``word, run, n``: words and their ids."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = kept_tree(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tree.ids_of(batch.column(0))), batch.column(1)], names=["word", "run", "n"])

    return counts.select("word", "n").mapInArrow(number, "word string, run long, n long")


def numbered_runs(counts: DataFrame, shared: Broadcast) -> DataFrame:
    """``run, context, suffix, n``: the tree's longest runs by their ids, without their last and without their first word."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = kept_tree(shared.value)
        level = len(tree.keys) - 1
        for batch in batches:
            a, b = (np.array(batch.column(i), dtype=np.int64) for i in (0, 1))
            one = b == -1
            context, suffix = np.where(one, a // tree.radix(level), a), np.where(one, a % tree.radix(level), b)
            yield pa.RecordBatch.from_arrays([pa.array(tree.extended(level, context, suffix)), pa.array(context), pa.array(suffix), batch.column(2)], names=["run", "context", "suffix", "n"])

    return counts.select("a", "b", "n").mapInArrow(number, "run long, context long, suffix long, n long")


def run_weights(levels: list[DataFrame], unseen: float, least_divergence: float) -> DataFrame:
    """``level, run, weight``: what every occurrence of a run adds to its text's log10 probability beyond the base.

    ``levels``: ``run, n`` of words and ``run, context, suffix, n`` of the longer runs;
    a word's base is its count and one more, times ``unseen``.
    """
    spark = levels[0].sparkSession
    words = levels[0].select("run", "n", ((F.col("n") + 1) * F.lit(unseen)).alias("p"))
    # Up from the root, as if all contexts were retained: what each gains over its suffix.
    found, shorter = [], words
    for runs in levels[1:]:
        met = runs.join(shorter.select(F.col("run").alias("suffix"), F.col("p").alias("below")), "suffix")
        every = (
            runs.groupBy("context")
            .agg(F.count(F.lit(1)).alias("t"), F.sum("n").alias("inside"))
            .join(shorter.select(F.col("run").alias("context"), F.col("n").alias("all")), "context")
            .select("context", (F.col("all") + F.col("t")).alias("of"), ((F.col("all") + F.col("t") - F.col("inside")) / (F.col("all") + F.col("t"))).alias("g"), (F.col("all") - F.col("inside")).alias("rest"))
        )
        own = F.col("n") / F.col("of") + F.col("g") * F.col("below")
        met = written(met.join(every, "context").select("run", "context", "n", "below", "of", "g", "rest", own.alias("p")), "suffix-runs")
        gain = F.sum(F.col("n") * F.log(F.col("p") / F.col("below"))) + F.first(F.col("rest") * F.log("g"))
        found.append(written(met.groupBy("context").agg(F.first("of").alias("of"), F.first("g").alias("g"), gain.alias("gain")), "suffix-contexts"))
        shorter = met.select("run", "n", "p")
    # Down again: suffixes of retained contexts are retained.
    kept, above = [], None
    for level in range(len(found), 0, -1):
        own = found[level - 1].filter(F.col("gain") >= least_divergence).select("context")
        if above is not None:
            own = own.union(above.join(levels[level].select(F.col("run").alias("context"), "suffix"), "context").select("suffix"))
        above = written(found[level - 1].join(own.distinct(), "context", "left_semi").select("context", "of", "g"), "suffix-kept")
        kept.insert(0, above)
    # Probabilities through retained contexts only.
    out, shorter = [], words.select("run", "p")
    for level, runs in enumerate(levels[1:], 1):
        met = runs.join(shorter.select(F.col("run").alias("suffix"), F.col("p").alias("below")), "suffix").join(kept[level - 1], "context", "left")
        p = F.when(F.col("of").isNotNull(), F.col("n") / F.col("of") + F.col("g") * F.col("below")).otherwise(F.col("below"))
        more = F.when(F.col("of").isNotNull(), F.log10("p") - F.log10("below") - F.log10("g")).otherwise(F.lit(0.0))
        met = written(met.withColumn("p", p).select("run", "p", more.alias("weight")), "suffix-probabilities")
        shorter = met.select("run", "p")
        out.append(kept[level - 1].select(F.lit(level - 1).alias("level"), F.col("context").alias("run"), F.log10("g").alias("weight")))
        out.append(met.select(F.lit(level).alias("level"), "run", "weight"))
    every = spark.createDataFrame([], "level int, run long, weight double")
    for part in out:
        every = every.union(part.filter(F.col("weight") != 0))
    return written(every.groupBy("level", "run").agg(F.sum("weight").alias("weight")), "suffix-weights")


class Tables(NamedTuple):
    """What rare words and runs meet: ``word, n`` of all training tokens, ``word, weight`` and ``run, weight``."""

    counts: DataFrame
    words: DataFrame
    runs: DataFrame


def learn(texts: DataFrame, *, depth: int = DEPTH, least_share: float = LEAST_SHARE, least_count: int = LEAST_COUNT, least_divergence: float = LEAST_DIVERGENCE) -> tuple[SuffixTree, Tables]:
    """The tree of all rows of ``text``, and the written tables of what is not in it."""
    counts = written(word_counts(texts), "word-counts")
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    often = max(least_count, int(np.ceil(least_share * whole["total"])))
    got = counts.filter((F.col("n") >= often) | (F.col("word") == END)).orderBy("word").toArrow()
    words, n = got.column("word").combine_chunks(), np.asarray(got.column("n"), dtype=np.int64)
    if END not in words.to_pylist():  # no training text
        words, n = pa.array([END, *words.to_pylist()], pa.string()), np.concatenate([[0], n])
    words = pa.concat_arrays(words.chunks) if isinstance(words, pa.ChunkedArray) else words
    tree = SuffixTree(words, whole["total"], whole["distinct"], n)
    share = texts.sparkSession.sparkContext.broadcast
    shared = share(tree)
    levels = [written(numbered_words(counts.filter(F.col("n") >= least_count), shared), "suffix-words")]
    shared.unpersist()
    for _ in range(depth):
        tree = SuffixTree(words, tree.total, tree.distinct, tree.counts, tree.keys, [*tree.bits, bits_of(levels[-1])])
        shared = share(tree)
        found = written(run_counts(texts, shared, least_count), "run-counts")
        shared.unpersist()
        frequent = line(found.filter(F.col("b") == -1), often, least_share, least_count)
        got = found.filter((F.col("b") == -1) & (F.col("n") >= frequent)).select("a").orderBy("a").toArrow()  # at most 1 / LEAST_SHARE rows
        keys = np.asarray(got.column("a"), dtype=np.int64)
        tree = SuffixTree(words, tree.total, tree.distinct, tree.counts, [*tree.keys, keys], tree.bits)
        shared = share(tree)
        levels.append(written(numbered_runs(found, shared), "suffix-level"))
        shared.unpersist()
    weights = run_weights(levels, 1.0 / (tree.total + tree.distinct + 1.0), least_divergence)
    tree.freeze(weights)
    rare = weights.filter(F.col("run") < -1)
    rare_words = levels[0].filter(F.col("run") < -1).join(rare.filter(F.col("level") == 0), "run").select("word", "weight")
    return tree, Tables(counts, rare_words, rare.filter(F.col("level") > 0).select("run", "weight"))


def token_parts(docs: DataFrame, tree: SuffixTree) -> DataFrame:
    """``doc_id, text_`` and what can be told of each text without the table of rare words, in one row or, for a long text, more.

    ``end`` marks one row of each; ``rare`` holds the words that are not frequent, with 0 for
    their run, and the ids of runs that are not, with no word.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = kept_tree(shared.value)
        reader = Reader(tree)
        item = pa.struct([("word", pa.string()), ("run", pa.int64()), ("n", pa.int32())])
        for batch in batches:
            for row, word, start, old, coded, place in reader.read(batch.column(2)):
                runs = tree.runs(word, start)
                value = tree.added(runs)
                new, known = ~old, word >= 0
                rows, own = np.unique(row, return_inverse=True)
                total = lambda x: np.bincount(own[new], weights=x[new], minlength=len(rows))
                n = total(np.ones(len(own))).astype(np.int64)
                counted = tree.counts[np.maximum(word, -1)] > 0
                n_known = total((known & counted).astype(float)).astype(np.int64)
                # Each rare word and run of each text once, with its count.
                rare = np.flatnonzero(word[place] < 0)
                size = max(1, len(coded.dictionary))
                key, times = np.unique(own[place[rare]] * size + np.asarray(coded.indices, dtype=np.int64)[rare], return_counts=True)
                text, spelled = key // size, coded.dictionary.take(pa.array(key % size)).cast(pa.string())
                met = [np.flatnonzero(new & (run < -1)) for run in runs[1:]]
                met = [at[among(tree.rare, run[at])] for at, run in zip(met, runs[1:])]
                met = [np.zeros((2, 0), dtype=np.int64), *(np.stack([own[at], run[at]]) for at, run in zip(met, runs[1:]))]
                text_of, run = np.concatenate(met, axis=1)
                text_of, run, run_times = repeated(text_of, run, np.ones(len(run), dtype=np.int64))
                order = np.argsort(np.concatenate([text, text_of]), kind="stable")
                spelled = pa.concat_arrays([spelled, pa.repeat("", len(run))]).take(pa.array(order))
                run = np.concatenate([np.zeros(len(text), dtype=np.int64), run])[order]
                times = np.concatenate([times, run_times])[order]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate([text, text_of]), minlength=len(rows)))])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([spelled, pa.array(run), pa.array(times, pa.int32())], fields=list(item)))
                ends = total((word == reader.end).astype(float)) > 0
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(ends), pa.array(total(np.where(known, tree.base[np.maximum(word, -1)], 0.0))), pa.array(total(value)), pa.array(n), pa.array(n_known), lists],
                    names=["doc_id", "text_", "end", "base", "score", "n_tokens", "n_known", "rare"],
                )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_"), "text").mapInArrow(score, f"doc_id {kind}, text_ long, {PARTS}")


def scored(docs: DataFrame, tree: SuffixTree, tables: Tables) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``docs``."""
    parts = token_parts(docs, tree)
    # One row per rare word or run of a text, and one that carries the sums; its key is no word's, and is spread.
    zero, none = F.lit(0).cast("long"), F.lit(0.0)
    sums = F.struct(F.col("end").cast("long").alias("ends"), "base", "score", "n_tokens", "n_known")
    own = F.struct(F.concat(F.lit(" "), F.xxhash64("doc_id", "text_").cast("string")).alias("word"), zero.alias("run"), F.lit(0).alias("n"), sums.alias("sums"))
    each = F.transform("rare", lambda x: F.struct(x["word"].alias("word"), x["run"].alias("run"), x["n"].alias("n"), F.lit(None).cast("struct<ends:long,base:double,score:double,n_tokens:long,n_known:long>").alias("sums")))
    rows = parts.select("doc_id", "text_", F.explode(F.concat(F.array(own), each)).alias("x")).select("doc_id", "text_", "x.*")
    times, weight = fresh(rows, "times"), fresh(rows, "weight")
    # A rare word with a weight meets two rows; the second tells no count.
    looked_up = tables.counts.select("word", zero.alias("run"), F.col("n").alias(times), none.alias(weight))
    looked_up = looked_up.union(tables.words.select("word", zero.alias("run"), F.lit(-1).cast("long").alias(times), F.col("weight").alias(weight)))
    looked_up = looked_up.union(tables.runs.select(F.lit("").alias("word"), "run", F.lit(-1).cast("long").alias(times), F.col("weight").alias(weight)))
    met = rows.join(looked_up, ["word", "run"], "left")
    log_p = F.log10((F.greatest(F.coalesce(times, zero), zero) + F.lit(1)).cast("double") / F.lit(float(tree.total + tree.distinct + 1)))
    rare = F.when((F.col("n") > 0) & (F.col("run") == 0) & (F.coalesce(times, zero) >= 0), F.col("n") * log_p).otherwise(none)
    more = F.col("n") * F.coalesce(weight, none)
    of = lambda c, other: F.coalesce(F.col("sums")[c], other)
    sums = met.groupBy("doc_id", "text_").agg(
        F.sum(of("ends", zero)).alias("copies"),
        F.sum(of("n_tokens", zero)).alias("n_tokens"),
        (F.sum(of("n_known", zero)) + F.sum(F.when(F.col(times) > 0, F.col("n")).otherwise(zero))).alias("n_known"),
        F.sum(of("base", none) + rare).alias("base"),
        F.sum(of("score", none) + rare + more).alias("score"),
    )
    # Rows repeated with the same id and text were added up.
    k = F.col("copies")
    return sums.select(F.explode(F.sequence(F.lit(1).cast("long"), k)).alias("copy"), "*").select(
        "doc_id",
        (remainder("doc_id", 7) == 2).alias("held_out"),
        F.call_function("div", F.col("n_tokens"), k).alias("n_tokens"),
        F.call_function("div", F.col("n_known"), k).alias("n_known"),
        F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") / k).alias("base_score"),
        (F.col("score") / k).alias("score"),
    )


def modelled(docs: DataFrame, **settings) -> DataFrame:
    """Learn from the documents that are not held out, score all.

    A NULL or empty text is one token, its end. Rows repeated with the same id and
    text get the same result each; a NULL id counts as empty text when held-out
    rows are chosen. Without training texts every probability is that of the one
    unknown token, 1. An empty table gives no rows; other columns are not looked at.
    """
    tree, tables = learn(docs.filter(remainder("doc_id", 7) != 2), **settings)
    return scored(docs, tree, tables)
