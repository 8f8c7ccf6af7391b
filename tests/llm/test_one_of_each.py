"""Near-duplicate removal where ids are missing or stand over several texts."""

from __future__ import annotations

import random

from strandflow.llm import simhash_planes as S

rng = random.Random(7)
WORDS = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]


def prose(n: int = 120) -> str:
    return " ".join(rng.choices(WORDS, k=n))


def near(text: str) -> str:
    """The first of the texts with one word more that links to ``text`` but has another fingerprint."""
    own = S.simhash(S.shingle_hashes(text))
    for w in WORDS:
        other = f"{text} {w}"
        if 0 < (own ^ S.simhash(S.shingle_hashes(other))).bit_count() <= S.RADIUS:
            return other
    raise AssertionError("no near copy")


def kept(spark, rows):
    got = S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(5))
    assert got.columns == ["doc_id", "text", "n"]
    return sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)


def test_different_texts_without_an_id_all_stay(spark):
    texts = [prose() for _ in range(9)]
    rows = [(None, t, i) for i, t in enumerate(texts)] + [(None, texts[0], 20), (None, near(texts[1]), 21)]
    got = kept(spark, rows)
    # One of the two near copies stays, whichever has the smaller hash.
    assert len(got) == 9 and {t for _, t in got} >= set(texts) - {texts[1]}


def test_different_texts_under_one_id_all_stay(spark):
    texts = [prose() for _ in range(9)]
    assert kept(spark, [(5, t, i) for i, t in enumerate(texts * 2)]) == sorted(((5, t) for t in texts), key=repr)


def test_a_near_copy_does_not_stand_in_for_another_text_of_its_id(spark):
    first, own = prose(), prose()
    rows = [(5, own, 1), (5, near(first), 2), (3, first, 3), (None, near(own), 4), (None, first, 5), (None, lone := prose(), 6)]
    for order in (rows, rows[::-1]):
        assert kept(spark, order) == sorted([(3, first), (5, own), (None, lone)], key=repr)
