"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts are words; a shared span of ``SPAN`` words or more is a leak. Of every
``SPAN`` consecutive words the smallest hash of ``GRAM`` consecutive words is a
fingerprint, so a shared span of that length has a fingerprint in common:
both sides take the minimum of the same hashes. Fingerprints of documents meet
those of the benchmark; around each hit, the windows of ``SPAN`` words that hold
it are compared with the benchmark's word by word. Nothing rests on hashes alone.

Items shorter than ``SPAN`` words are one window each; their hash is looked for
at every place of every document (only where the benchmark has such items).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.llm.common import written

SPAN = 10
GRAM = 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is; pure ASCII texts take the fast way."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters; a NULL text has none."""
    parts = F.split(lowered(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.array_remove(parts, "")


def tail(a: Column, by: int) -> Column:
    return F.slice(a, by + 1, F.greatest(F.size(a) - by, F.lit(0)))


def head(a: Column, by: int) -> Column:
    return F.slice(a, 1, F.greatest(F.size(a) - by, F.lit(0)))


def paired(a: Column, by: int, f) -> Column:
    """``f`` of each element and the one ``by`` places on."""
    return F.zip_with(head(a, by), tail(a, by), f)


def with_grams(df: DataFrame, shorts: list[int]) -> DataFrame:
    """Adds to ``words``: ``g`` (hash of the ``GRAM`` words at each place) and ``s<m>`` for each short length."""
    df = df.withColumn("h", F.transform("words", lambda x: F.xxhash64(x)))
    df = df.withColumn("g", paired(F.col("h"), 1, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("g", paired(F.col("g"), 2, lambda a, b: F.xxhash64(a, b)))
    for m in shorts:
        own, length = f"s{m}", F.lit(m)
        df = df.withColumn(own, F.transform("h", lambda x: F.xxhash64(length, x)))
        for by in range(1, m):
            df = df.withColumn(own, F.zip_with(head(F.col(own), 1), tail(F.col("h"), by), lambda a, b: F.xxhash64(a, b)))
    return df.drop("h")


def minima(df: DataFrame) -> DataFrame:
    """Adds ``marks``: the distinct smallest hashes of all ``SPAN`` words (7 hashes of 4 words each)."""
    smaller = lambda a, b: F.least(a, b)
    df = df.withColumn("m", paired(F.col("g"), 1, smaller))
    df = df.withColumn("m", paired(F.col("m"), 2, smaller))
    df = df.withColumn("m", paired(F.col("m"), 3, smaller))
    return df.withColumn("marks", F.array_distinct("m")).drop("m")


def fingerprints(df: DataFrame, shorts: list[int]) -> DataFrame:
    """``words`` to ``marks``: winnowed hashes, and every short window's hash."""
    df = minima(with_grams(df, shorts))
    for m in shorts:
        df = df.withColumn("marks", F.concat("marks", F.array_distinct(f"s{m}")))
    return df


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """``window, span, items``: each distinct window of the benchmark with the items that hold it."""
    own = benchmark.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    span = F.least(F.size("words"), F.lit(SPAN))
    at = own.withColumn("span", span).select("item_id", "words", "span", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)).alias("at"))
    cut = at.select("item_id", "span", F.array_join(F.slice("words", F.col("at"), F.col("span")), " ").alias("window"))
    return cut.groupBy("window", "span").agg(F.sort_array(F.collect_set("item_id")).alias("items"))


def marks_of_benchmark(benchmark: DataFrame, shorts: list[int]) -> DataFrame:
    own = benchmark.select(words(F.col("text")).alias("words"))
    long = minima(with_grams(own.filter(F.size("words") >= SPAN), [])).select(F.explode("marks").alias("mark"))
    for m in shorts:
        short = with_grams(own.filter(F.size("words") == m), [m]).select(F.explode(f"s{m}").alias("mark"))
        long = long.unionByName(short)
    return long.distinct()


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    A NULL text has no words; items with a NULL id mark words but are not counted
    as items; items without words match nothing. Rows repeated with the same id
    and text get the same result. An empty benchmark leaves all documents clean.
    """
    every = written(benchmark_windows(benchmark), "windows")
    shorts = sorted(r["span"] for r in every.filter(F.col("span") < SPAN).select("span").distinct().collect())  # at most nine lengths
    known = written(marks_of_benchmark(benchmark, shorts), "marks")

    own = docs.select(F.col("doc_id"), F.xxhash64("text").alias("text_"), F.col("text"))
    read = fingerprints(own.select("doc_id", "text_", words(F.col("text")).alias("words")), shorts)
    # One row per fingerprint, and one that carries the document itself; its key is a hash, so it is spread.
    self = F.struct(F.xxhash64("doc_id", "text_").alias("mark"), F.lit(True).alias("self"))
    rows = read.select(
        "doc_id",
        "text_",
        F.size("words").cast("long").alias("n_words"),
        F.explode(F.concat(F.array(self), F.transform("marks", lambda x: F.struct(x.alias("mark"), F.lit(False).alias("self"))))).alias("m"),
    ).select("doc_id", "text_", "n_words", "m.*")
    met = rows.join(known.withColumn("known", F.lit(True)), "mark", "left").filter("self OR known")
    met = written(met.select("doc_id", "text_", "n_words", "mark", "self"), "hits")

    hit = met.filter("NOT self").groupBy(F.col("doc_id").alias("id_"), F.col("text_").alias("other_")).agg(F.collect_set("mark").alias("marks_"))
    near = own.join(hit, own["doc_id"].eqNullSafe(hit["id_"]) & (own["text_"] == hit["other_"])).select("doc_id", "text_", "marks_", words(F.col("text")).alias("words"))
    near = with_grams(near.dropDuplicates(["doc_id", "text_"]), shorts)
    n = F.size("words")
    places = lambda c: F.filter(F.transform(c, lambda x, i: F.when(F.array_contains("marks_", x), i)), lambda i: i.isNotNull())
    # A window that holds the hit at p starts between p - (SPAN - GRAM) and p.
    around = F.when(
        n >= SPAN,
        F.array_distinct(F.flatten(F.transform(places("g"), lambda p: F.sequence(F.greatest(p - (SPAN - GRAM), F.lit(0)), F.least(p, n - SPAN))))),
    ).otherwise(F.array().cast("array<int>"))
    windows = lambda at, span: F.transform(at, lambda s: F.struct(s.alias("at"), F.lit(span).alias("span")))
    starts = windows(around, SPAN)
    for m in shorts:
        starts = F.concat(starts, windows(places(f"s{m}"), m))
    near = near.withColumn("starts", starts)
    tried = near.select(
        "doc_id",
        "text_",
        F.explode(
            F.transform("starts", lambda s: F.struct(s["at"].alias("at"), s["span"].alias("span"), F.array_join(F.slice("words", s["at"] + 1, s["span"]), " ").alias("window")))
        ).alias("w"),
    ).select("doc_id", "text_", "w.*")
    same = tried.join(every, ["window", "span"])
    per_doc = same.groupBy(F.col("doc_id").alias("id_"), F.col("text_").alias("other_")).agg(
        F.collect_list(F.struct("at", "span")).alias("covered"), F.collect_set("items").alias("items")
    )
    per_doc = per_doc.select(
        "id_",
        "other_",
        F.size(F.array_distinct(F.flatten(F.transform("covered", lambda c: F.sequence(c["at"], c["at"] + c["span"] - 1))))).cast("long").alias("n_hit"),
        F.sort_array(F.transform(F.array_distinct(F.flatten("items")), lambda x: x.cast("string"))).alias("items"),
    )
    all_rows = met.filter("self")
    out = all_rows.join(per_doc, all_rows["doc_id"].eqNullSafe(per_doc["id_"]) & (all_rows["text_"] == per_doc["other_"]), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        "text_",
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, unchanged, that share no window with the benchmark."""
    bad = leaks(docs, benchmark).filter("contaminated").select(F.col("doc_id").alias("id_"), "text_").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["id_"]) & (F.xxhash64(docs["text"]) == bad["text_"]), "left_anti")


SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT item_id, w, least(len(w), {SPAN}) AS span FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, span, array_to_string(w[s : s + span - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS s FROM i)),
dw AS (SELECT rid, s, span, array_to_string(w[s : s + span - 1], ' ') AS win
       FROM (SELECT rid, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d, (SELECT DISTINCT span FROM bw))),
h AS (SELECT rid, s, span, item_id FROM dw JOIN bw USING (span, win)),
p AS (SELECT rid, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT rid, unnest(range(s, s + span)) AS q FROM h) GROUP BY rid),
m AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (rid) LEFT JOIN m USING (rid)
"""
