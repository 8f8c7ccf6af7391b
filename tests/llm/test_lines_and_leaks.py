from __future__ import annotations

import hashlib
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import SCHEMA, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import license_digest, line_windows, winnow  # noqa: E402
from strandflow.llm.license_texts import BSD_HEAD, BSD_TAIL, MIT  # noqa: E402


def by_lines(docs: list[tuple]) -> dict:
    """{(id, text): (kept text, lines, removed)} by walking all windows in order."""
    seen, out = set(), {}
    for key, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        if text is None:
            out[key, text] = (None, 0, 0)
            continue
        lines = text.split("\n")
        bare = [x.strip(" \t\r") for x in lines]
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(bare[i : i + 3])
            if any(w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[key, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


def line_rows(df):
    return sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in df.select("doc_id", "text", "n_lines", "n_removed").collect()), key=repr)


def test_line_windows_equal_brute_force(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abcde") + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(0, 14)))) for i in range(120)]
    want = by_lines(docs)
    got = line_windows.deduplicated(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert line_rows(got) == sorted(((k, *want[k, t][:1], *want[k, t][1:]) for k, t in docs), key=repr)


def test_line_windows_of_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows() if r[0] is not None]
    want = by_lines(docs)
    df = odd_docs(spark)
    got = line_windows.deduplicated(df)
    assert set(df.columns) <= set(got.columns)
    assert line_rows(got.filter("doc_id IS NOT NULL")) == sorted(((k, *want[k, t][:1], *want[k, t][1:]) for k, t in docs), key=repr)
    assert got.filter("doc_id IS NULL AND n_removed = 0").count() == 2
    kept = line_windows.without_emptied(df)
    assert kept.columns == df.columns and kept.filter("n_lines = 'other n_lines'").count() == kept.count()
    # Document 9 is all of document 8 again; 8 twice under one id is one document.
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted((r[0] or 0) for r in rows() if r[0] != 9)
    assert line_windows.deduplicated(no_docs(spark)).count() == 0


def test_long_covered_texts_are_cut_in_one_walk(spark):
    text = "\n".join(f"line {i}" for i in range(20_000))
    got = line_windows.deduplicated(spark.createDataFrame([(1, text), (2, "new\n" + text + "\nend")], "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {1: text, 2: "new\nend"}


def by_words(docs, items):
    low = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    wins = defaultdict(set)
    for item, text in items:
        w = low(text)
        m = min(len(w), 10)
        for i in range(len(w) - m + 1 if w else 0):
            wins[tuple(w[i : i + m])].add(item)
    spans = {len(w) for w in wins}
    out = []
    for key, text in docs:
        w, hit, found = low(text), set(), set()
        for m in spans:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    hit |= set(range(i, i + m))
                    found |= wins[tuple(w[i : i + m])]
        names = sorted(str(x) for x in found if x is not None)
        out.append((key, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def leak_rows(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in df.collect()), key=repr)


@pytest.mark.parametrize("letters, short", [("abcdefghijklmnop", False), ("ab", False), ("abc", True)])
def test_winnowing_equals_brute_force(spark, letters, short):
    rng = random.Random(len(letters))
    say = lambda n: " ".join(rng.choice(letters) + rng.choice(["", "É", "1"]) for _ in range(n))
    items = [(i, say(rng.randint(10, 30))) for i in range(12)] + ([(100 + m, say(m)) for m in (1, 3, 9)] if short else [])
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 30))
        if i % 2:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            text += " " + "  ".join(w[a : a + rng.choice([8, 9, 10, 11, 30])]).upper().replace("É", "É") + ", " + say(rng.randint(0, 15))
        docs.append((i, text))
    got = winnow.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert leak_rows(got) == by_words(docs, items)


def test_winnowing_of_odd_rows(spark):
    docs = [(r[0], r[1]) for r in rows()]
    items = [(1, rows()[0][1]), (1, rows()[0][1]), (2, None), (3, ""), (None, rows()[1][1]), (4, "zzz yyy xxx www vvv uuu ttt sss rrr qqq"), (5, "line 17 of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = odd_docs(spark)
    assert leak_rows(winnow.leaks(df, bench)) == by_words(docs, items)
    clean = winnow.clean(df, bench)
    bad = {r[0] for r in by_words(docs, items) if r[5]}
    assert clean.columns == df.columns
    # The row without an id that repeats document 1 is contaminated too; the other one is not.
    assert sorted(r["doc_id"] or 0 for r in clean.collect()) == sorted([0] + [d for d, _ in docs if d is not None and d not in bad])
    none = spark.createDataFrame([], "item_id long, text string")
    assert winnow.leaks(df, none).filter("contaminated").count() == 0 and winnow.leaks(df, none).count() == len(docs)
    assert winnow.leaks(no_docs(spark), bench).count() == 0


def test_licences_by_digest(spark):
    odd = MIT.upper().replace("SUBLICENSE", "sub-licence").replace("NONINFRINGEMENT", "non-infringement")
    docs = [
        (1, "Copyright (c) 2020 Somebody\n\n" + MIT),
        (2, odd + "\n\n(c) A. N. Other"),
        (3, MIT + " and one word"),
        (4, "\n".join(["© 1999 X", BSD_HEAD, "", "*" * 20, BSD_TAIL])),
        (5, "Some prose.\nReleased under the MIT License.\nmore\nLicensed under the Apache Licence, Version 2.0\n -- released under the mit license"),
        (6, None),
        (7, ""),
        (7, ""),
        (8, "copyright 2001 all of it"),
    ]
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in license_digest.scanned(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1][0] == got[2][0] == "MIT" and got[3][0] is None and got[4][0] == "BSD-2-Clause"
    assert got[5] == (None, 3, "Apache-2.0,MIT")
    assert got[6] == got[7] == got[8] == (None, 0, "")


def test_licences_of_odd_rows(spark):
    df = odd_docs(spark)
    got = license_digest.scanned(df)
    assert got.count() == len(rows()) and got.filter("license IS NOT NULL OR n_notices > 0").count() == 0
    assert got.filter("digest IS NULL").count() == 2
    assert license_digest.scanned(no_docs(spark)).count() == 0
    own = spark.createDataFrame([], SCHEMA)
    assert license_digest.scanned(own, license_digest.known(spark)).count() == 0
