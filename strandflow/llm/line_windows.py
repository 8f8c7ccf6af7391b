"""Line dedup by overlapping windows of three lines, in DataFrame functions only.

Every three consecutive lines of a document are a window. Windows that occur
more than once in the corpus keep their first occurrence (smallest ``doc_id``,
then place); the lines of all later occurrences are covered, and covered places
are merged and removed. A repeated passage of three lines or more thus stays
once, wherever it starts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import fresh

WINDOW = 3


def windows(docs: DataFrame) -> DataFrame:
    """``id_, text_, pos, a, b``: the windows of every text that have a line with content.

    Lines are compared without blanks at their ends. ``a`` and ``b`` are hashes
    of different seeds, 128 bits together. ``text_`` is the hash of the text: rows
    that share id and text are one document.
    """
    hashed = docs.select(
        F.col("doc_id").alias("id_"),
        F.xxhash64("text").alias("text_"),
        F.expr(r"transform(split(text, '\n'), x -> trim(BOTH ' \t\r' FROM x))").alias("lines"),
    ).select(
        "id_",
        "text_",
        F.expr("transform(lines, x -> struct(xxhash64(x) AS a, xxhash64(1, x) AS b, x = '' AS blank))").alias("h"),
    )
    rows = hashed.filter(F.size("h") >= WINDOW).select(
        "id_",
        "text_",
        F.explode(
            F.expr(
                """transform(sequence(0, size(h) - 3), i -> struct(i AS pos,
                   xxhash64(h[i].a, h[i + 1].a, h[i + 2].a) AS a, xxhash64(h[i].b, h[i + 1].b, h[i + 2].b) AS b,
                   h[i].blank AND h[i + 1].blank AND h[i + 2].blank AS blank))"""
            )
        ).alias("w"),
    )
    return rows.filter(~F.col("w.blank")).select("id_", "text_", "w.pos", "w.a", "w.b")


def later_occurrences(docs: DataFrame) -> DataFrame:
    """``id_, text_, starts``: per document, the places of windows that occurred before.

    Occurrences are counted and their first found by an aggregate that combines
    map side, so a window that a third of the corpus holds is one row per task
    there; in the join back it is the many side of one row, which AQE splits.
    """
    every = windows(docs)
    place = F.struct("id_", "text_", "pos")
    first = every.groupBy("a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = every.join(first, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("id_", "text_").agg(F.sort_array(F.collect_set("pos")).alias("starts"))


def uncovered(lines: Column, starts: Column) -> Column:
    """The lines outside [start, start + 3) of all (ascending) starts."""
    before = lambda k: F.when(k == 0, 0).otherwise(F.element_at(starts, k) + WINDOW)
    after = lambda k: F.when(k == F.size(starts), F.size(lines)).otherwise(F.element_at(starts, k + 1))
    gaps = F.transform(
        F.sequence(F.lit(0), F.size(starts)),
        lambda k: F.slice(lines, before(k) + 1, F.greatest(after(k) - before(k), F.lit(0))),
    )
    return F.flatten(gaps)


def deduplicated(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with the kept text in ``text``, and ``n_lines, n_removed``.

    A NULL text stays NULL with no lines; texts of fewer than three lines stay as
    they are; a text all of whose lines are later occurrences becomes empty. Rows
    repeated with the same id and text get the same result. NULL ids sort first.
    """
    other, starts, lines = fresh(docs, "other"), fresh(docs, "starts"), fresh(docs, "lines")
    found = later_occurrences(docs).withColumnRenamed("text_", other).withColumnRenamed("starts", starts)
    key = fresh(docs, "id_")
    found = found.withColumnRenamed("id_", key)
    joined = docs.join(found, docs["doc_id"].eqNullSafe(found[key]) & (F.xxhash64(docs["text"]) == found[other]), "left")
    cut = joined.withColumn(lines, F.split("text", "\n")).withColumn(
        starts, F.when(F.col(starts).isNotNull(), uncovered(F.col(lines), F.col(starts)))
    )
    kept = F.col(starts)
    return cut.select(
        *[c for c in docs.columns if c not in ("text", "n_lines", "n_removed")],
        F.when(kept.isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(kept.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).cast("long").alias("n_removed"),
    )


def without_emptied(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages removed; those that lose all their lines go.

    The columns are those of ``docs``, in their order.
    """
    out = deduplicated(docs.withColumnsRenamed({c: f"{c}__" for c in docs.columns if c in ("n_lines", "n_removed")}))
    out = out.filter("n_removed = 0 OR n_removed < n_lines").drop("n_lines", "n_removed")
    return out.withColumnsRenamed({f"{c}__": c for c in ("n_lines", "n_removed")}).select(*docs.columns)


SQL = """
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM s),
w AS (SELECT doc_id, pos, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z
      FROM (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS x FROM l) WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
later AS (SELECT doc_id, pos FROM (
      SELECT doc_id, pos, row_number() OVER (PARTITION BY x, y, z ORDER BY doc_id, pos) AS k
      FROM w WHERE z IS NOT NULL AND x || y || z <> '') WHERE k > 1),
c AS (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM later),
k AS (SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
        string_agg(line, chr(10) ORDER BY l.pos) FILTER (c.pos IS NULL) AS kept
      FROM l LEFT JOIN c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
