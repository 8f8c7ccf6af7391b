"""Language by prediction by partial matching over bytes.

One context tree holds, for every language, how often each byte followed each
context of up to ``ORDER`` bytes in that language's training texts. The counts
are frozen; a text's code length in a language is the sum over its bytes of

    -log2 count / (total + distinct)             where the byte is known there,
    -log2 distinct / (total + distinct), and on  in the context one byte shorter,

down to eight bits for a byte never seen. The language with the shortest code
is predicted, and the score is its posterior with all languages equally likely.

Training counts are gathered by Spark from a hash sample of ``SAMPLE_DOCS``
labelled documents a language (a bound of the classifier; whole texts). Every
label is learned, and each keeps its own ``LANGUAGE_NODES`` most frequent nodes,
whatever the others have. Languages share a tree in turns of ``TURN``, so that a
worker's tables hold one turn however many languages there are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import fresh, give_back, remainder, slices, written

#: Bytes of context.
ORDER = 3
#: Labelled documents a language is learned from, at most and about.
SAMPLE_DOCS = 400
#: Nodes each language keeps.
LANGUAGE_NODES = 75_000
#: Languages of one tree; the next ones are in trees of their own.
TURN = 8
#: Bytes scored at once.
SLICE = 1 << 20
UNDETERMINED = "und"
ROW = "held_out boolean, lang_pred string, score double, bits_per_byte double"

LETTER = re.compile("[A-Za-z]")
SPACES = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
#: Digits, punctuation and controls say nothing about the language.
DROPPED = bytes(b for b in range(128) if not chr(b).isalpha() and not chr(b).isspace() or 28 <= b < 32)


def plain(text: str) -> bytes:
    """Lower-case bytes of letters and spaces."""
    return text.lower().encode("utf-8", "replace").translate(SPACES, DROPPED)


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass
class ContextTree:
    """``grams[n]`` are the known byte strings of length n + 1, ``counts[n]`` their counts by language."""

    languages: list[str]
    grams: list[np.ndarray]
    counts: list[np.ndarray]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)
    #: The trees of further languages.
    more: list["ContextTree"] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.tables = None

    @property
    def every_language(self) -> list[str]:
        return [x for tree in (self, *self.more) for x in tree.languages]

    def every_code_length(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language, one tree's tables in memory at a time."""
        found = []
        for tree in (self, *self.more):
            found.append(tree.code_lengths(texts))
            if self.more:
                tree.thaw()
        return np.concatenate(found, axis=1)

    def thaw(self) -> None:
        self.cost = self.escape = self.child = self.tables = None

    @property
    def order(self) -> int:
        return len(self.grams) - 1

    def freeze(self) -> None:
        """Code lengths of every node, of every escape, and the child of every node by byte."""
        n_lang = len(self.languages)
        self.cost, self.escape, self.child = [], [], []
        for n, (grams, counts) in enumerate(zip(self.grams, self.counts)):
            parents = self.grams[n - 1] if n else np.zeros(1, dtype=np.int64)
            parent = np.searchsorted(parents, grams >> 8) if n else np.zeros(len(grams), dtype=np.int64)
            total, distinct = np.zeros((len(parents), n_lang)), np.zeros((len(parents), n_lang))
            np.add.at(total, parent, counts)
            np.add.at(distinct, parent, counts > 0)
            known = total > 0
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(known, -np.log2(distinct / (total + distinct)), 0.0)
                own = -np.log2(counts / (total + distinct)[parent])
            shorter = self.cost[n - 1][np.searchsorted(self.grams[n - 1], grams & ((1 << 8 * n) - 1)) + 1] if n else 8.0
            cost = np.where(counts > 0, own, escape[parent] + shorter)
            # Row 0 of each table stands for "not known".
            self.cost.append(np.vstack([np.zeros((1, n_lang)), cost]).astype(np.float32))
            self.escape.append((np.vstack([np.zeros((1, n_lang)), escape]) if n else escape).astype(np.float32))
            child = np.zeros((len(parents) + 1) * 256 if n else 256, dtype=np.int32)
            child[(parent + (n > 0)) * 256 + (grams & 255)] = np.arange(1, len(grams) + 1)
            self.child.append(child)
        self.tables = True

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of every text in every language."""
        if self.tables is None:
            self.freeze()
        # A zero byte, which no text has, before each text: contexts end there.
        raw = np.frombuffer(b"".join(b"\0" + t for t in texts), dtype=np.uint8)
        lengths = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        ids, before = [], np.zeros(len(raw), dtype=np.int32)
        for n, child in enumerate(self.child):
            at = child[raw] if n == 0 else child[before * np.int32(256) + raw]
            ids.append(at)
            before = np.empty_like(at)
            before[0], before[1:] = 0, at[:-1]
        bits = self.cost[-1][ids[-1]]
        rest = np.flatnonzero((ids[-1] == 0) & (raw != 0))
        for n in range(self.order, -1, -1):
            if n < self.order:
                bits[rest] += self.cost[n][ids[n][rest]]
                rest = rest[ids[n][rest] == 0]
            if n:
                bits[rest] += self.escape[n][ids[n - 1][rest - 1]]
            else:
                bits[rest] += self.escape[0][0] + np.float32(8)
        return np.add.reduceat(bits, np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)


TREES: dict[str, ContextTree] = {}


def kept_tree(tree: ContextTree) -> ContextTree:
    """The worker's own copy of a tree, with its tables made once; only the last one is kept."""
    if tree.key not in TREES:
        TREES.clear()
        TREES[tree.key] = tree
    return TREES[tree.key]


def train(
    labelled: DataFrame, *, order: int = ORDER, sample_docs: int = SAMPLE_DOCS, language_nodes: int = LANGUAGE_NODES, max_nodes: int | None = None, turn: int = TURN
) -> ContextTree:
    """Learn from ``doc_id, text, lang``; rows with a NULL in text or lang teach nothing.

    ``max_nodes`` cuts each tree further, to its most frequent nodes over all its languages.
    """
    rows = labelled.select("doc_id", "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    found = rows.groupBy("lang").count().orderBy("lang").collect()  # one row a label
    languages = sorted(r["lang"] for r in found)
    if not languages:
        return ContextTree([], [], [])
    share = F.create_map(*(x for r in found for x in (F.lit(r["lang"]), F.lit(min(1.0, sample_docs / r["count"])))))
    sample = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            for row, texts in slices(batch.column(1)):
                own = langs[row : row + len(texts)]
                for lang in np.unique(own):
                    raw = np.frombuffer(b"".join(b"\0" + plain(t) for t, x in zip(texts, own) if x == lang), dtype=np.uint8)
                    gram, good = np.zeros(len(raw), dtype=np.int64), np.ones(len(raw), dtype=bool)
                    for n in range(order + 1):
                        # The string of n + 1 bytes that ends at each place, none across two texts.
                        shifted = raw[: len(raw) - n] if n else raw
                        gram[n:] |= shifted.astype(np.int64) << (8 * n)
                        good[:n] = False
                        good[n:] &= shifted > 0
                        value, times = np.unique(gram[good], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(value), pa.string()), pa.array(np.full(len(value), n), pa.int32()), pa.array(value), pa.array(times, pa.int64())],
                            names=["lang", "n", "gram", "times"],
                        )

    counted = sample.mapInArrow(count, "lang string, n int, gram long, times long")
    place = F.create_map(*(x for i, name in enumerate(languages) for x in (F.lit(name), F.lit(i))))[F.col("lang")]
    nodes = written(counted.groupBy(place.alias("place"), "n", "gram").agg(F.sum("times").alias("times")), "grams")
    # A node is never more frequent than its prefix or suffix, so what a language keeps is closed under both.
    most = F.row_number().over(Window.partitionBy("place").orderBy(F.desc("times"), "n", "gram"))
    own = nodes.withColumn("most", most).filter(F.col("most") <= language_nodes)
    of_turn = F.floor(F.col("place") / turn).cast("int").alias("turn")
    kept = own.select(of_turn, "n", "gram").distinct()
    width = min(turn, len(languages))
    by = [F.sum(F.when(F.col("place") % turn == i, F.col("times")).otherwise(0)).alias(f"l{i}") for i in range(width)]
    counts_of = nodes.select(of_turn, "*").join(kept, ["turn", "n", "gram"], "left_semi").groupBy("turn", "n", "gram").agg(F.sum("times").alias("all"), *by)
    trees = []
    for k in range(0, len(languages), turn):
        wanted = counts_of.filter(F.col("turn") == k // turn)
        if max_nodes is not None:
            wanted = wanted.orderBy(F.desc("all"), "n", "gram").limit(max_nodes)
        got, names = wanted.toArrow(), languages[k : k + turn]  # at most ``language_nodes`` a language
        level, gram = np.asarray(got.column("n")), np.asarray(got.column("gram"))
        table = np.stack([np.asarray(got.column(f"l{i}"), dtype=np.float64) for i in range(len(names))], axis=1)
        grams, counts = [], []
        for n in range(order + 1):
            at = np.flatnonzero(level == n)
            at = at[np.argsort(gram[at])]
            grams.append(gram[at])
            counts.append(table[at])
        trees.append(ContextTree(names, grams, counts))
    trees[0].more = trees[1:]
    return trees[0]


def verdicts(tree: ContextTree, texts: list[str]) -> tuple[list, list, list]:
    """The language, its posterior and the mean bits of a byte of every text."""
    names = tree.every_language
    lang, value, mean = [UNDETERMINED] * len(texts), [0.0] * len(texts), [None] * len(texts)
    chosen = [i for i, t in enumerate(texts) if tree.languages and has_letter(t)]
    if chosen:
        raw = [plain(texts[i]) for i in chosen]
        bits = tree.every_code_length(raw)
        best = bits.argmin(axis=1)
        least = bits.min(axis=1)
        posterior = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        for i, b, p, m, r in zip(chosen, best.tolist(), posterior.tolist(), least.tolist(), raw):
            lang[i], value[i], mean[i] = names[b], p, m / max(1, len(r))
    return lang, value, mean


def predict(docs: DataFrame, tree: ContextTree) -> DataFrame:
    """All columns of ``docs`` but the text, then ``held_out, lang_pred, score, bits_per_byte``.

    Texts that are NULL or have no letter are undetermined with score 0 and no
    bits; so is every text where no language was learned. Ties go to the
    language that sorts first. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tree)
    out = docs.select("doc_id", "text", (remainder("doc_id", 4) == 2).alias("held_out"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = kept_tree(shared.value)
        for batch in batches:
            for row, texts in slices(batch.column(1), SLICE):
                lang, value, mean = verdicts(tree, texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(texts)), batch.column(2).slice(row, len(texts)), pa.array(lang, pa.string()), pa.array(value, pa.float64()), pa.array(mean, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score", "bits_per_byte"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(score, f"doc_id {kind}, {ROW}")


def identified(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, predict all."""
    return predict(docs, train(docs.filter(remainder("doc_id", 4) != 2)))


def in_known_languages(docs: DataFrame) -> DataFrame:
    """The documents, unchanged, that ``predict`` gives a language; all with a letter where none was learned.

    Texts in a script without labelled rows get the nearest learned language,
    however many bits they take, and stay. The texts are judged where they lie:
    nothing is shuffled.
    """
    tree = docs.sparkSession.sparkContext.broadcast(train(docs.filter(remainder("doc_id", 4) != 2)))

    @F.arrow_udf("boolean")
    def fits(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = kept_tree(tree.value)
        for column in columns:
            good = np.zeros(len(column), dtype=bool)
            for row, texts in slices(column, SLICE):
                if model.languages:
                    good[row : row + len(texts)] = [x != UNDETERMINED for x in verdicts(model, texts)[0]]
                else:
                    good[row : row + len(texts)] = [has_letter(t) for t in texts]
            yield pa.array(good)
        give_back()

    mark = fresh(docs, "fits")
    return docs.withColumn(mark, fits("text")).filter(mark).drop(mark)
