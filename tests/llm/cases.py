"""Small document tables with every odd case the operators promise to take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns a caller may have that sound like those of the operators.
CLASHING = ("id_", "text_", "lines", "starts", "other", "n_lines", "n_removed", "marks", "words", "fits", "fp", "fp_", "kept_id", "score", "held_out", "digest", "first", "n", "a", "b", "pos", "size", "members", "sequence_id", "offset", "component_id", "least")

ENGLISH = "the quick brown fox jumps over the lazy dog and then it goes home to the other side of the hill"
FRENCH = "le chat noir dort sous la table et les enfants jouent dans le jardin avec leurs amis de la ville"
LONG = "\n".join(f"line {i} of a long text with some words in it" for i in range(4000))


def rows() -> list[tuple]:
    repeated = f"{ENGLISH}\nsecond line here\nthird line here\nfourth line"
    return [
        (1, ENGLISH, "en", "s0", 10),
        (2, FRENCH, "fr", "s0", 10),
        (3, None, "en", "s0", None),
        (4, "", "en", None, 0),
        (5, "   \n\t\r\n ", None, "s1", 3),
        (6, LONG, "en", "s1", 10),
        (7, "123 !!! ###", "fr", "s1", 10),
        (8, repeated, "en", "s1", 1),
        (8, repeated, "en", "s1", 1),
        (9, repeated, None, None, None),
        (None, ENGLISH, "en", "s2", 10),
        (None, None, None, None, None),
        (10, "a", "en", "s2", 1),
        (11, "\n".join(["x"] * 9), "fr", "s2", 17),
        (12, FRENCH.upper() + " ÉÈ ß €", "fr", "s2", 10),
        (13, "word " * 3000, "en", "s2", 10),
        (14, "\x1c \x85 \xa0   z\x00y", "en", "s3", 4),
    ]


def odd_docs(spark: SparkSession) -> DataFrame:
    df = spark.createDataFrame(rows(), SCHEMA)
    return df.withColumns({c: F.lit(f"other {c}") for c in CLASHING})


def no_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def documents(spark: SparkSession) -> DataFrame:
    return spark.read.parquet(f"{SF}/documents.parquet")
