"""How far the sources of a language are apart, from a frequent-pattern tree of term rows.

A language keeps the terms that enough of its documents use. A kept term's row
lists the sources that use it, in source order, with their counts. Every count
gives a share in billionths, ``1 + floor(10^9 (count + 5) / (N + 5 V))``, and two
sources are as far apart as their shares of all kept terms differ in sum.

Were all counts zero, two sources would differ by ``V`` times the difference of
their shares of nothing. What the counts change is summed over a tree into which
the rows are inserted, equal beginnings sharing a path: an item (source, count)
corrects its source against every other source that lacks the term, by the
number of rows that hold it, and a node corrects its source against those of its
ancestors, once for all rows that share the path.

Rows are dealt to blocks of about ``BLOCK`` terms, each a tree of its own, so no
task holds a language; a task holds the sums of all pairs of sources of one
language, which are the rows of that language's result. All arithmetic is in
whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import pieces, written

LEAST_DOCS = 30
ADDED = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Terms of one tree, about.
BLOCK = 4096
#: Rows of counts a task holds before it adds them up and sends them on.
HELD_ROWS = 200_000
#: Bytes of text worked on at once.
PIECE_BYTES = 3 << 19
#: All ASCII but letters parts terms.
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
COUNTED = "lang string, source string, term string, n long, docs long"
NAMES = ["lang", "source", "term", "n", "docs"]


def terms(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All terms of ``texts`` one after the other, A-Z in lower case, and the text each stands in."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), APART)
    words, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), np.asarray(text.filter(there))


def added_up(tables: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables).group_by(NAMES[:3], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns(NAMES)


def counted(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences of every term in every group, and documents with it."""

    def of_texts(batch: pa.RecordBatch) -> Iterator[pa.Table]:
        lang, source = batch.column(0), batch.column(1)
        _, group = np.unique(np.asarray(lang.dictionary_encode().indices, dtype=np.int64) * batch.num_rows + np.asarray(source.dictionary_encode().indices, dtype=np.int64), return_inverse=True)
        first_of = np.zeros(group.max(initial=-1) + 1, dtype=np.int64)
        first_of[group[::-1]] = np.arange(len(group))[::-1]
        started: list[pa.Table] = []

        def rows_of(rows: np.ndarray, names: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.Table:
            at = pa.array(rows)
            return pa.Table.from_arrays([lang.take(at), source.take(at), names, pa.array(n), pa.array(docs)], names=NAMES)

        for rows, texts, ended in pieces(batch.column(2), PIECE_BYTES):
            words, text = terms(texts)
            coded = words.dictionary_encode()
            number, size = np.asarray(coded.indices, dtype=np.int64), max(1, len(coded.dictionary))
            # Each (text, term) once with its count, then each (group, term).
            each, n = np.unique(text.astype(np.int64) * size + number, return_counts=True)
            if ended and not started:
                key, own = np.unique(group[rows[each // size]] * size + each % size, return_inverse=True)
                total = np.zeros(len(key), dtype=np.int64)
                np.add.at(total, own, n)
                yield rows_of(first_of[key // size], coded.dictionary.take(pa.array(key % size)), total, np.bincount(own, minlength=len(key)))
                continue
            # A text in pieces: its terms are gathered first, as each counts its documents once.
            started.append(rows_of(rows[each // size], coded.dictionary.take(pa.array(each % size)), n, np.zeros(len(n), dtype=np.int64)))
            if ended:
                whole = added_up(started)
                yield whole.set_column(4, "docs", pa.array(np.ones(len(whole), dtype=np.int64)))
                started = []

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for table in of_texts(batch):
                held.append(table)
                n += len(table)
                if n > HELD_ROWS:
                    held = [added_up(held)]
                    n = len(held[0])
                    if n > HELD_ROWS // 2:
                        yield from held[0].to_batches(max_chunksize=50_000)
                        held, n = [], 0
        if held:
            yield from added_up(held).to_batches(max_chunksize=50_000)

    return docs.select("lang", "source", "text").mapInArrow(count, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def term_rows(docs: DataFrame, *, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, entries``: the kept terms with their (source, n), in source order."""
    row = F.array_sort(F.collect_list(F.struct("source", "n"))).alias("entries")
    return counted(docs).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), row).filter(F.col("docs") >= least_docs).drop("docs")


def share(n: Column, total: Column, kept: Column) -> Column:
    """The share in billionths by whole-number division: the products pass 64 bits."""
    above = (n + F.lit(ADDED)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + F.lit(ADDED) * kept).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def shares(n: list[int], total: list[int], kept: int) -> np.ndarray:
    """The same in a task."""
    return np.array([1 + SCALE * (a + ADDED) // (b + ADDED * kept) for a, b in zip(n, total)], dtype=np.int64)


class PatternTree:
    """Rows of items, inserted with multiplicities: nodes are the distinct beginnings of rows."""

    def __init__(self, items: np.ndarray, lengths: np.ndarray):
        """``items`` holds the rows one after the other."""
        start = np.cumsum(lengths) - lengths
        kinds = int(items.max(initial=-1)) + 1
        item, parent, times = [], [], []
        under, made = np.full(len(lengths), -1, dtype=np.int64), 0
        for depth in range(int(lengths.max(initial=0))):
            rows = np.flatnonzero(lengths > depth)
            key, own, count = np.unique((under[rows] + 1) * kinds + items[start[rows] + depth], return_inverse=True, return_counts=True)
            item.append(key % kinds)
            parent.append(key // kinds - 1)
            times.append(count)
            under[rows] = own + made
            made += len(key)
        none = [np.zeros(0, dtype=np.int64)]
        self.item, self.parent, self.times = (np.concatenate(x or none) for x in (item, parent, times))

    def header(self) -> tuple[np.ndarray, np.ndarray]:
        """Every item with the number of rows that hold it."""
        item, own = np.unique(self.item, return_inverse=True)
        times = np.zeros(len(item), dtype=np.int64)
        np.add.at(times, own, self.times)
        return item, times

    def with_ancestors(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item, item of an ancestor, rows through the node) of every node and ancestor, a generation at a time."""
        node, above = np.arange(len(self.item)), self.parent
        while len(node := node[above >= 0]):
            above = above[above >= 0]
            yield self.item[node], self.item[above], self.times[node]
            above = self.parent[above]


def corrections(left: pa.Table, right: pa.Table) -> pa.Table:
    """``lang, a, b, value`` of a block: what its counts add to the distance of each two sources.

    ``left`` has the block's rows, ``right`` the sources of the language with their totals.
    """
    if left.num_rows == 0:
        return pa.table({"lang": pa.array([], pa.string()), "a": pa.array([], pa.string()), "b": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    names, kept = right.column("source").to_pylist(), right.column("kept")[0].as_py()
    totals = right.column("total").to_pylist()
    nothing = shares([0] * len(names), totals, kept)
    entries = left.column("entries").combine_chunks()
    entries = entries.chunk(0) if isinstance(entries, pa.ChunkedArray) else entries
    flat = entries.flatten()
    number = np.asarray(pc.index_in(flat.field("source"), pa.array(names, flat.field("source").type)), dtype=np.int64)
    pair, items = np.unique(np.stack([number, np.asarray(flat.field("n"), dtype=np.int64)], axis=1), axis=0, return_inverse=True)
    source, p = pair[:, 0], shares(pair[:, 1].tolist(), [totals[i] for i in pair[:, 0].tolist()], kept)
    tree = PatternTree(items.ravel(), np.asarray(pc.list_value_length(entries), dtype=np.int64))

    value = np.zeros((len(names), len(names)), dtype=np.int64)
    for item, times in zip(*(x.tolist() for x in tree.header())):
        own = source[item]
        value[own] += times * (np.abs(p[item] - nothing) - np.abs(nothing[own] - nothing))
    value += value.T
    for item, above, times in tree.with_ancestors():
        a, b = source[item], source[above]
        both = np.abs(p[item] - p[above]) - np.abs(p[item] - nothing[b]) - np.abs(nothing[a] - p[above]) + np.abs(nothing[a] - nothing[b])
        np.add.at(value, (a, b), times * both)
        np.add.at(value, (b, a), times * both)
    np.fill_diagonal(value, 0)
    a, b = np.nonzero(value)
    out = pa.array(names, pa.string())
    lang = pa.array([right.column("lang")[0].as_py()] * len(a), pa.string())
    return pa.Table.from_arrays([lang, out.take(pa.array(a)), out.take(pa.array(b)), pa.array(value[a, b])], names=["lang", "a", "b", "value"])


def group_totals(groups: DataFrame, rows: DataFrame) -> DataFrame:
    """``lang, source, total, kept`` of every group that occurs: its occurrences of kept terms, and the kept terms of its language."""
    totals = rows.select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.n").alias("total"))
    kept = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    zero = F.lit(0).cast("long")
    return (
        groups.distinct()
        .join(totals, ["lang", "source"], "left")
        .join(kept, "lang", "left")
        .select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("kept", zero).alias("kept"))
    )


def pair_part(rows: DataFrame, groups: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """``lang, source, item, value``: each two sources of a language and their distance."""
    blocks = groups.select("lang", "kept").distinct().select("lang", F.greatest(F.lit(1), F.ceil(F.col("kept") / block)).cast("int").alias("blocks"))
    dealt = rows.join(blocks, "lang").select("lang", F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), "entries")
    there = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "total", "kept")
    changed = (
        dealt.groupBy("lang", "block").cogroup(there.groupBy("lang", "block")).applyInArrow(corrections, "lang string, a string, b string, value long")
    ).groupBy("lang", "a", "b").agg(F.sum("value").alias("changed"))
    nothing = F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(F.lit(0))
    one = groups.select("lang", F.col("source").alias("a"), "kept", nothing.alias("p"))
    other = groups.select("lang", F.col("source").alias("b"), nothing.alias("q"))
    pairs = one.join(other, "lang").filter(F.col("a") != F.col("b")).join(changed, ["lang", "a", "b"], "left")
    value = F.col("kept") * F.abs(F.col("p") - F.col("q")) + F.coalesce("changed", F.lit(0))
    return pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("long").alias("value"))


def term_part(rows: DataFrame, groups: DataFrame, *, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, item, value``: the terms a source uses most beyond its language, at most ``top`` a source, by value and term."""
    whole = groups.groupBy("lang").agg(F.sum("total").alias("all"))
    used = rows.select("lang", "term", F.aggregate("entries", F.lit(0).cast("long"), lambda s, e: s + e["n"]).alias("n_all"), F.explode("entries").alias("e"))
    both = used.select("lang", "term", "n_all", "e.source", "e.n").join(groups, ["lang", "source"]).join(whole, "lang")
    over = share(F.col("n"), F.col("total"), F.col("kept")) - share(F.col("n_all"), F.col("all"), F.col("kept"))
    found = both.select("lang", "source", F.col("term").alias("item"), over.cast("long").alias("value")).filter("value > 0")
    first = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return found.withColumn("first", first).filter(F.col("first") <= top).drop("first")


def audited(docs: DataFrame, *, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK) -> DataFrame:
    """``lang, source, part, item, value, rank``: distances to the other sources, and the terms a source overuses.

    NULL in text, lang or source reads as empty. Every (lang, source) that occurs
    has all other sources of its language as items, at distance 0 where the
    language keeps no term. Repeated rows count each; ties rank by UTF-8 bytes of
    the item; an empty table gives no rows. Other columns are not looked at.
    """
    own = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = written(term_rows(own, least_docs=least_docs), "term-rows")
    groups = written(group_totals(own.select("lang", "source"), rows), "groups")
    parts = [
        df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))
        for part, df in (("pair", pair_part(rows, groups, block=block)), ("term", term_part(rows, groups, top=top)))
    ]
    return parts[0].unionByName(parts[1])


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n_all FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_all)::HUGEINT AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source)::HUGEINT AS total, v.v, v.n AS lang_n, k.n_all
      FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + ({SCALE}::HUGEINT * (n + {ADDED})) // (total + {ADDED} * v) AS p, 1 + ({SCALE}::HUGEINT * (n_all + {ADDED})) // (lang_n + {ADDED} * v) AS q FROM f),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
