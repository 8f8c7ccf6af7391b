"""Draw documents that look like a target corpus: importance weights over hashed n-grams.

Texts stay Arrow arrays. ``ascii_lower``, ``split_pattern_regex`` and
``list_flatten`` make words, ``dictionary_encode`` numbers them; runs of words
are formed from shifted dictionary indices, and only distinct runs are written
out and hashed. A bucket's gain compares how often the target and the source
corpus use it; ``take`` gives every run its gain and a segmented sum gives every
text its weight.

Counts are over whole tables: a task sends at most one number a bucket. The
gains of all ``BUCKETS`` are the only thing that reaches the driver and every
task, and their number is a parameter.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandflow.llm.common import pieces, written

BUCKETS = 10_000
LONGEST = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
#: Everything that is not a digit, a letter or beyond ASCII parts words.
APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SCORED = "n_features long, n_words long, weight long"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` one after the other, A-Z in lower case, and the text each stands in."""
    parts = pc.split_pattern_regex(pc.ascii_lower(texts), APART)
    words, text = pc.list_flatten(parts), pc.list_parent_indices(parts)
    there = pc.greater(pc.binary_length(words), 0)
    return words.filter(there), np.asarray(text.filter(there))


def hashed(strings: pa.Array) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, strings.cast(pa.binary()).to_pylist()), dtype=np.int64, count=len(strings))


def features(words: pa.Array, text: np.ndarray, longest: int, buckets: int, carried: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every run of 1 to ``longest`` words of one text; runs within the first ``carried`` words are left out."""
    coded = words.dictionary_encode()
    single, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    bucket = hashed(names) % buckets
    texts, found = [text[carried:]], [bucket[single[carried:]]]
    run, spelled = single, names
    for n in range(2, longest + 1):
        if len(single) < n:
            break
        # A run is a shorter run and the word after it; both numbers together tell it apart.
        inside = text[n - 1 :] == text[: len(text) - n + 1]
        pair, own = np.unique(run[:-1] * len(names) + single[n - 1 :], return_inverse=True)
        spelled = pc.binary_join_element_wise(spelled.take(pa.array(pair // len(names))), names.take(pa.array(pair % len(names))), " ")
        run = own
        chosen = np.flatnonzero(inside)
        chosen = chosen[chosen + n - 1 >= carried]
        texts.append(text[n - 1 :][chosen])
        found.append((hashed(spelled) % buckets)[run[chosen]])
    return np.concatenate(texts), np.concatenate(found)


def runs(column: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row of every word, row of every run, bucket of every run) of an Arrow column, some megabytes at a time."""
    carried = pa.array([], column.type)
    for rows, texts, ended in pieces(column):
        words, text = split(texts)
        held = len(carried)
        if held:
            words, text = pa.concat_arrays([carried, words]), np.concatenate([np.zeros(held, dtype=text.dtype), text])
        at, bucket = features(words, text, longest, buckets, held)
        yield rows[text[held:]], rows[at], bucket
        # A text that goes on hands its last words to its next piece.
        carried = words.slice(0, 0) if ended else words.slice(max(0, len(words) - longest + 1))


def bucket_counts(texts: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: how many runs of all rows of ``text`` fall in each bucket that has any. NULL texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, bucket in runs(batch.column(0), longest, buckets):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Floored thousandths of the log ratio of smoothed bucket shares, target over source."""
    s_all, t_all, k = float(source.sum()), float(target.sum()), float(len(source))
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + k) / ((s + 1) * (t_all + k)))) for s, t in zip(source.astype(float).tolist(), target.astype(float).tolist())],
        dtype=np.int64,
    )


def learn(source: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of every bucket, from whole tables with a column ``text``; empty tables count nothing."""

    def held(df: DataFrame) -> np.ndarray:
        out = np.zeros(buckets, dtype=np.int64)
        for r in bucket_counts(df, longest=longest, buckets=buckets).collect():  # at most one row a bucket
            out[r["bucket"]] = r["n"]
        return out

    return gains_of(held(source), held(target))


def weighed(docs: DataFrame, gains: np.ndarray, *, longest: int = LONGEST) -> DataFrame:
    """``doc_id, text_, n_features, n_words, weight`` of every row; ``text_`` is the hash of the text, without features the weight is 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = pa.array(shared.value)
        for batch in batches:
            n, n_words, total = (np.zeros(batch.num_rows, dtype=np.int64) for _ in range(3))
            for word_row, row, bucket in runs(batch.column(1), longest, len(gain)):
                n_words += np.bincount(word_row, minlength=batch.num_rows)
                if len(row) == 0:
                    continue
                order = slice(None) if longest == 1 else np.argsort(row, kind="stable")
                row, each = row[order], np.asarray(gain.take(pa.array(bucket)))[order]
                first = np.flatnonzero(np.diff(row, prepend=-1))
                total[row[first]] += np.add.reduceat(each, first)
                n += np.bincount(row, minlength=batch.num_rows)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x) for x in (n, n_words, weight))], names=["doc_id", "text_", "n_features", "n_words", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_")).mapInArrow(weigh, f"doc_id {kind}, text_ long, {SCORED}")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise of an id in floored thousandths: the same for every engine and run. A NULL id reads as empty."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def drawn(scored: DataFrame, *, least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """Adds ``rank`` to the highest-scored ``percent`` of the rows with enough words, NULL elsewhere.

    Scores are small whole numbers, so a count of each (a bounded table: their
    range follows from 64-bit counts and 32-bit noise, some 10^5 values) gives the
    places before every score; only rows of one score are sorted against each
    other, by id (NULL last), then by text.
    """
    scored = written(scored, "scores")
    long_enough = F.col("n_words") >= least_words
    each = written(scored.filter(long_enough).groupBy("score").agg(F.count(F.lit(1)).alias("n_score")), "score-counts")
    chosen = (each.agg(F.coalesce(F.sum("n_score"), F.lit(0)).alias("n")).first()["n"] * percent) // 100
    places = each.select("score", (F.sum("n_score").over(Window.orderBy(F.desc("score"))) - F.col("n_score")).alias("before")).filter(F.col("before") < chosen)
    top = scored.filter(long_enough).join(places, "score", "left")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "text_"))
    inside = top.filter(F.col("before").isNotNull()).withColumn("rank", place)
    inside = inside.withColumn("rank", F.when(F.col("rank") <= chosen, F.col("rank")))
    outside = top.filter(F.col("before").isNull()).drop("before").unionByName(scored.filter(~long_enough)).withColumn("rank", F.lit(None).cast("long"))
    return inside.drop("before").unionByName(outside)


def resampled(docs: DataFrame, target: DataFrame, *, longest: int = LONGEST, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` (long) of every row of ``docs``.

    Learns from ``text`` of all rows of ``docs`` and ``target``. A NULL or empty
    text has no features, weight 0 and is never drawn; repeated rows are rows of
    their own, with ranks of their own; empty tables give an empty result. Other
    columns are not looked at.
    """
    gains = learn(docs, target, longest=longest, buckets=buckets)
    scored = weighed(docs, gains, longest=longest).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    return drawn(scored, least_words=least_words, percent=percent).select("doc_id", "n_features", "weight", "score", "rank")


SQL = rf"""
WITH crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::UBIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
      lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) AS v FROM range(256) r(i))),
a AS (SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents UNION ALL SELECT NULL, NULL, text, false FROM benchmark),
w AS (SELECT rid, own, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM a),
d AS (SELECT w, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM w GROUP BY w),
b AS (SELECT w, s, t.t AS tab, d.t, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode(w))), lambda j: ('0x' || substr(hex(encode(w)), (2 * j + 1)::INT, 2))::UBIGINT)),
      lambda x, y: xor(x >> 8, tab[((xor(x, y) & 255) + 1)::INT])), 4294967295::UBIGINT) % {BUCKETS} AS bucket FROM d, crc t),
g AS (SELECT bucket, floor(1000 * ln((sum(t)::DOUBLE + 1) * ((SELECT sum(s) FROM b)::DOUBLE + {BUCKETS}) / ((sum(s)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM b)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM b GROUP BY bucket),
p AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS total FROM w JOIN b USING (w) JOIN g USING (bucket) WHERE own GROUP BY rid),
f AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN floor(total::DOUBLE / n)::BIGINT ELSE 0 END AS weight,
      ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM a LEFT JOIN p USING (rid) WHERE own),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id) AS k,
      count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) * {PERCENT} // 100 AS chosen FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND k <= chosen THEN k END AS rank FROM r
"""
