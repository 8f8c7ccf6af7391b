"""Quality rules as a ledger: each rule is evaluated once and leaves one bit.

``measure`` reads a text once and counts; ``ledger`` adds ``failures``, an
integer whose bit *i* says that rule *i* failed. Policies are versioned masks
over those bits, so a new policy, or what one rule alone costs, is answered
from the ledger without reading a text again.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import slices

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long"
NAMES = [m.split()[0] for m in MEASURES.split(", ")]
SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``fails`` is a condition on the measures, in whole numbers."""

    name: str
    fails: str


#: The order fixes the bits; new rules are appended.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 AND 100 * n_dup_lines > n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("shouting", "2 * n_upper > word_chars"),
)
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: Versions stay as they were published.
POLICIES = {1: BASE, 2: BASE | BIT["symbols"] | BIT["repeated_lines"] | BIT["short_words"] | BIT["long_words"] | BIT["shouting"]}
CURRENT = 2


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that stand in the text twice or more, first occurrences included."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    inside, covered_to = 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            inside += i + 3 - max(i, covered_to)
            covered_to = i + 3
    return inside


def measures(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.split()]
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the measures of every row; a NULL text has no words. One row for each row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in slices(batch.column(1)):
                columns = zip(*map(measures, texts))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", *NAMES])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, {MEASURES}")


def failures() -> Column:
    """The bits of all failed rules."""
    bits = F.lit(0)
    for r in RULES:
        bits = bits.bitwiseOR(F.when(F.expr(r.fails), BIT[r.name]).otherwise(0))
    return bits


def passes(policy: int) -> Column:
    return F.col("failures").bitwiseAND(POLICIES[policy]) == 0


def ledger(docs: DataFrame) -> DataFrame:
    """Measures and failure bits of every document: what is kept for later policies."""
    return measure(docs).withColumn("failures", failures())


def ablation(entries: DataFrame, policy: int) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that fail no other rule of it.

    Documents are counted per bit pattern first (at most two to the number of
    rules), so every further step is over a few rows.
    """
    mask = POLICIES[policy]
    patterns = entries.groupBy(F.col("failures").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).alias("bit")) for r in RULES if BIT[r.name] & mask))
    return (
        patterns.select("bits", "n", F.explode(rules).alias("r"))
        .groupBy("r.rule")
        .agg(
            F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        )
    )


def judged(docs: DataFrame, policy: int = CURRENT) -> DataFrame:
    """Every document with its measures, its bits, and the verdict of a policy.

    ``base_failed`` is the verdict of the base rules alone; ``kept`` is false for
    those and for what the policy adds. NULL and empty texts have no words and fail.
    Each row is judged for itself, so repeated rows get equal verdicts.
    """
    base = F.col("failures").bitwiseAND(BASE) != 0
    return ledger(docs).select(
        "doc_id",
        *NAMES[:5],
        base.alias("base_failed"),
        (~base & passes(policy)).alias("kept"),
        "failures",
        F.lit(policy).alias("policy"),
    )


#: The same rows in DuckDB's SQL (the measures by lists, the bits by the same conditions).
SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w,
        [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS lines FROM t),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM l WHERE len(w) > 2)),
r AS (SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
p AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS q FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM l LEFT JOIN p USING (rid)),
f AS (SELECT *, {" | ".join(f"CASE WHEN {r.fails} THEN {BIT[r.name]} ELSE 0 END" for r in RULES)} AS failures FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {BASE}) <> 0 AS base_failed,
  (failures & {BASE | POLICIES[CURRENT]}) = 0 AS kept, failures::INTEGER AS failures, {CURRENT} AS policy
FROM f
"""
