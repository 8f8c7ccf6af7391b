"""Licence scan by canonical digests.

A text is brought into canonical form: ASCII letters in lower case, copyright
lines left out, punctuation and white space as single spaces, equivalent
spellings as one. The digest of a whole text's form is joined to the digests of
known licences, so a text is a licence exactly if it is one in that form. The
lines of a text are looked up in the same way for one-line notices ("Released
under the ... License."), which is how licences mostly appear inside documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm.license_texts import EQUIVALENT, FULL, NAMED, PHRASES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line of this kind names a holder and a year, not terms.
COPYRIGHT = r"(?m)^[ \t]*(copyright|\(c\)|©)[^\n]*$"
SEPARATOR = r"[^a-z0-9\x80-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    low = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    out = F.regexp_replace(F.regexp_replace(low, COPYRIGHT, " "), SEPARATOR, " ")
    # Double spaces between words let neighbouring spellings be replaced independently.
    out = F.concat(F.lit(" "), F.trim(out), F.lit(" "))
    for old, new in EQUIVALENT:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(out)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession) -> DataFrame:
    """``digest, license, notice``: whole licences, and notices where ``notice`` is true."""
    rows = [(t, name, False) for name, t in FULL]
    rows += [(p.format(n), name, True) for name, names in NAMED for n in names for p in PHRASES]
    rows += [(PHRASES[-1].format(name), name, True) for name, _ in NAMED]
    table = spark.createDataFrame(rows, "text string, license string, notice boolean")
    return table.select(digest(F.col("text")).alias("digest"), "license", "notice").distinct()


def scanned(docs: DataFrame, licenses: DataFrame | None = None) -> DataFrame:
    """``doc_id, digest, license, n_notices, notices`` of every row.

    ``license`` is that of the whole text or NULL; ``notices`` are the licences
    that lines of the text name, sorted and joined by commas, ``n_notices`` the
    lines that do. A NULL text has a NULL digest and matches nothing, an empty one
    has the digest of nothing. Rows repeated with the same id and text agree.
    The licence table may be any; Spark broadcasts it only if its size allows.
    """
    licenses = known(docs.sparkSession) if licenses is None else licenses
    whole = licenses.filter("NOT notice").groupBy("digest").agg(F.min("license").alias("license"))
    lines = licenses.filter("notice").groupBy(F.col("digest").alias("line_")).agg(F.min("license").alias("named"))
    own = docs.select("doc_id", F.xxhash64("text").alias("text_"), "text")
    # Lines are told apart by place, so rows that are repeated count once.
    each = own.select("doc_id", "text_", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    found = (
        each.select("doc_id", "text_", "pos", digest(F.col("line")).alias("line_"))
        .join(lines, "line_")
        .groupBy(F.col("doc_id").alias("id_"), F.col("text_").alias("other_"))
        .agg(F.count_distinct("pos").alias("n"), F.array_join(F.sort_array(F.collect_set("named")), ",").alias("notices"))
    )
    marked = own.select("doc_id", "text_", digest(F.col("text")).alias("digest")).join(whole, "digest", "left")
    out = marked.join(found, marked["doc_id"].eqNullSafe(found["id_"]) & (marked["text_"] == found["other_"]), "left")
    return out.select("doc_id", "digest", "license", F.coalesce("n", F.lit(0)).alias("n_notices"), F.coalesce("notices", F.lit("")).alias("notices"))


def sql_form(text: str) -> str:
    out = f"regexp_replace(regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', ' ', 'g'), '{SEPARATOR}', ' ', 'g')"
    out = f"' ' || trim({out}) || ' '"
    for old, new in EQUIVALENT:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim({out})"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


FULL_SQL = ", ".join(f"({quoted(t)}, {quoted(n)})" for n, t in FULL)
NOTICE_SQL = ", ".join(
    f"({quoted(t)}, {quoted(n)})" for n, names in NAMED for t in [p.format(x) for x in names for p in PHRASES] + [PHRASES[-1].format(n)]
)
SQL = f"""
WITH k AS (SELECT DISTINCT sha256({sql_form("text")}) AS digest, license FROM (VALUES {FULL_SQL}) v(text, license)),
n AS (SELECT DISTINCT sha256({sql_form("text")}) AS digest, license FROM (VALUES {NOTICE_SQL}) v(text, license)),
d AS (SELECT doc_id, text, sha256({sql_form("text")}) AS digest FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
      FROM (SELECT doc_id, sha256({sql_form("line")}) AS digest FROM l) JOIN n USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, license, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices
FROM d LEFT JOIN k USING (digest) LEFT JOIN f USING (doc_id)
"""
