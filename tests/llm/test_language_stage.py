"""The pipeline's language stage keeps what the operator gives a language, and texts with letters where none was learned."""

from __future__ import annotations

import zlib

from strandflow.llm import ppm_language as P

SCHEMA = "doc_id long, text string, lang string"
HELD = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
SHOWN = [i for i in range(400) if i not in HELD]


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_scripts_without_labelled_rows_stay(spark):
    rows = [(i, f"the cat sat on the mat number {i} and the dog lay by the door", "en") for i in SHOWN[:30]]
    rows += [(1000, "η γάτα κάθεται στο χαλί", None), (1001, "кошка сидит на ковре", None), (1002, "12 + 3", "en"), (1003, None, "en"), (1004, "é", None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    said = {r["doc_id"]: r for r in P.identified(docs).collect()}
    assert said[1000]["bits_per_byte"] > 8 and said[1000]["lang_pred"] == "en"
    assert ids(P.in_known_languages(docs)) == sorted(i for i, r in said.items() if r["lang_pred"] != "und")
    assert {1000, 1001, 1004} <= set(ids(P.in_known_languages(docs)))


def test_letters_stay_where_no_language_was_learned(spark):
    texts = ["some words", "λίγα λόγια", "1 2 3", "", None]
    without = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], SCHEMA)
    assert ids(P.in_known_languages(without)) == [0, 1]
    # The labelled rows are all held out.
    held = spark.createDataFrame([(i, t, "en") for i, t in zip(HELD, texts)] + [(i, t, None) for i, t in zip(SHOWN, texts)], SCHEMA)
    assert {r["lang_pred"] for r in P.identified(held).collect()} == {"und"}
    assert ids(P.in_known_languages(held)) == sorted([*HELD[:2], *SHOWN[:2]])
