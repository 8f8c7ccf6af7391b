"""Importance draw, suffix tree and divergence tree against plain loops over the same rows."""

from __future__ import annotations

import hashlib
import math
import re
import sys
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import LONG, documents, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import common  # noqa: E402
from strandflow.llm import divergence_tree as D  # noqa: E402
from strandflow.llm import importance_draw as I  # noqa: E402
from strandflow.llm import suffix_tree as S  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
TOKEN = r"[^\x20\x09-\x0D]+"


def found(pattern, text):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_pieces_hold_every_text_once(size):
    texts = ["ab cd", None, "", "x" * 200, "some words " * 30, "a b", "end"]
    got = {}
    for rows_, part, ended in common.pieces(pa.array(texts), size):
        for r, t in zip(rows_.tolist(), part.to_pylist()):
            got.setdefault(r, []).append((t, ended))
    assert ["".join(t for t, _ in got[i]) for i in range(len(texts))] == [t or "" for t in texts]
    assert all([e for _, e in g] == [False] * (len(g) - 1) + [True] for g in got.values())
    assert size > 50 or len(got[4]) > 1


# --- importance draw ----------------------------------------------------------


def plain_runs(text, longest):
    w = found(WORD, text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


def plain_draw(docs, target, longest, buckets, least, percent, seed):
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in plain_runs(text, longest)) for texts in ([d[1] for d in docs], target))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    out = []
    for i, text in docs:
        runs = plain_runs(text, longest)
        weight = sum(gain(bucket(x)) for x in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(found(WORD, text))])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in out]


@pytest.mark.parametrize("longest,piece", [(1, None), (3, None), (3, 100)])
def test_draw_equals_a_plain_loop(spark, monkeypatch, longest, piece):
    if piece:
        monkeypatch.setattr(I, "pieces", lambda c: common.pieces(c, piece))
    docs = documents(spark).unionByName(spark.createDataFrame([(10_000 + i, r[1], "en", "s", 1) for i, r in enumerate(rows())], documents(spark).schema)).coalesce(2)
    target = spark.createDataFrame([("the house of the lord",), (None,), ("un deux trois",)], "text string")
    if piece:  # the function the workers run, without a worker
        column = pa.array([r["text"] for r in docs.collect()], pa.string())
        cut = [np.concatenate(x) for x in zip(*[(r, b) for _, r, b in I.runs(column, longest, 500)])]
        monkeypatch.undo()
        whole = [np.concatenate(x) for x in zip(*[(r, b) for _, r, b in I.runs(column, longest, 500)])]
        assert sorted(zip(*map(np.ndarray.tolist, cut))) == sorted(zip(*map(np.ndarray.tolist, whole)))
        return
    got = I.resampled(docs, target, longest=longest, buckets=500, percent=30).collect()
    want = plain_draw([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], longest, 500, 20, 30, 2024)
    key = lambda r: (r[0], *[str(x) for x in r[1:]])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_draw_of_odd_rows(spark):
    df = odd_docs(spark)
    got = I.resampled(df, df.select("text"), percent=100).collect()
    assert len(got) == len(rows())
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    able = sum(len(found(WORD, r[1])) >= 20 for r in rows())
    assert ranks == list(range(1, able + 1))
    assert all(r["weight"] == 0 and r["rank"] is None for r in got if r["doc_id"] in (3, 4, 5))
    assert I.resampled(no_docs(spark), no_docs(spark)).count() == 0
    alone = I.resampled(df, no_docs(spark))
    assert alone.count() == len(rows()) and alone.columns == ["doc_id", "n_features", "weight", "score", "rank"]


# --- suffix tree --------------------------------------------------------------


class PlainTree:
    """The same model with dictionaries of word runs."""

    def __init__(self, texts, depth, least, divergence):
        own = [[*found(TOKEN, t), ""] for t in texts]
        runs = [Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1)) for n in range(1, depth + 2)]
        self.c1 = runs[0]
        self.n, self.v, self.depth = sum(runs[0].values()), len(runs[0]), depth
        self.c = {r: k for level in runs for r, k in level.items() if k >= least or r == ("",)}
        self.next = {}
        for r in self.c:
            if len(r) > 1:
                self.next.setdefault(r[:-1], []).append(r[-1])
        every = set(self.next)
        self.kept = every
        self.kept = {s for s in every if self.divergence(s) >= divergence}
        for s in sorted(self.kept, key=len, reverse=True):
            self.kept |= {s[i:] for i in range(1, len(s))}

    def base(self, w):
        return (self.c1[(w,)] + 1) / (self.n + self.v + 1)

    def gap(self, s):
        weight = self.c[s] + len(self.next[s])
        return (weight - sum(self.c[(*s, w)] for w in self.next[s])) / weight

    def p(self, s, w):
        if not s:
            return self.base(w)
        if s not in self.kept:
            return self.p(s[1:], w)
        return (self.c[(*s, w)] / (self.c[s] + len(self.next[s])) if (*s, w) in self.c else 0) + self.gap(s) * self.p(s[1:], w)

    def divergence(self, s):
        inside = sum(self.c[(*s, w)] for w in self.next[s])
        out = sum(self.c[(*s, w)] * math.log(self.p(s, w) / self.p(s[1:], w)) for w in self.next[s])
        return out + (self.c[s] - inside) * math.log(self.gap(s))

    def score(self, text):
        w = [*found(TOKEN, text), ""]
        return sum(math.log10(self.p(tuple(w[max(0, i - self.depth) : i]), x)) for i, x in enumerate(w))


@pytest.mark.parametrize("depth,least,divergence", [(2, 2, 1.0), (3, 3, 0.0), (1, 5, 8.0)])
def test_scores_equal_a_plain_tree(spark, depth, least, divergence):
    docs = documents(spark).unionByName(spark.createDataFrame([(10_000 + i, r[1], "en", "s", 1) for i, r in enumerate(rows())], documents(spark).schema))
    got = {r["doc_id"]: r for r in S.modelled(docs, depth=depth, least_count=least, least_share=0.0, least_divergence=divergence).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    tree = PlainTree([t for i, t in texts.items() if not held(i)], depth, least, divergence)
    assert len(got) == len(texts) and (tree.kept or depth == 1)
    for i, t in texts.items():
        w, r = [*found(TOKEN, t), ""], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(tree.c1[(x,)] > 0 for x in w), tree.n)
        assert r["base_score"] == pytest.approx(sum(math.log10(tree.base(x)) for x in w), rel=1e-9, abs=1e-9)
        assert r["score"] == pytest.approx(tree.score(t), rel=1e-9, abs=1e-9)
    for s in [(), *sorted(tree.kept)[:20]]:
        assert sum(tree.p(s, w) for (w,) in tree.c1) + tree.p(s, "never seen") == pytest.approx(1)


@pytest.mark.parametrize("share", [1e-3, 1.0])
def test_rare_contexts_count_as_in_a_plain_tree(spark, share):
    """What is too rare to be broadcast is met in a join, with the same scores."""
    docs = documents(spark)
    got = {r["doc_id"]: r["score"] for r in S.modelled(docs, least_share=share, least_count=3, least_divergence=1.0).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    tree = PlainTree([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], 2, 3, 1.0)
    assert any(tree.c[s] < 1e-3 * tree.n for s in tree.kept) and len(got) == len(texts)
    assert all(got[i] == pytest.approx(tree.score(t), rel=1e-9, abs=1e-9) for i, t in texts.items())


def test_long_texts_with_rare_runs_are_scored_alike(spark, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([LONG, "some words of one line", "some words of one line", LONG])], "doc_id long, text string")
    whole = {r["doc_id"]: r["score"] for r in S.modelled(docs, least_share=1.0, least_count=2, least_divergence=0.0).collect()}
    monkeypatch.setattr(S, "PIECE_BYTES", 100)
    small = {r["doc_id"]: r["score"] for r in S.modelled(docs, least_share=0.0, least_count=2, least_divergence=0.0).collect()}
    assert whole == pytest.approx(small, rel=1e-9) and len(whole) == 4


def test_held_out_texts_are_likelier_than_by_their_words(spark):
    got = S.modelled(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out").toPandas()
    assert got["score"].sum() > got["base_score"].sum() and (got["score"] > got["base_score"]).mean() > 0.8


def test_long_texts_in_pieces_are_scored_alike(spark, monkeypatch):
    tree, _ = S.learn(spark.createDataFrame([(LONG,), ("a line of words",)], "text string"), least_share=0.0, least_count=2)
    column = pa.array(["short one", LONG, None, "x" * 500, "a line of a long text"], pa.string())

    def sums(size):
        monkeypatch.setattr(S, "PIECE_BYTES", size)
        out = np.zeros((len(column), 2))
        for row, word, start, old, _, _ in S.Reader(tree).read(column):
            value = tree.scores(word, start)
            np.add.at(out, row[~old], np.stack([value, np.ones(len(value))], axis=1)[~old])
        return out

    assert np.allclose(sums(100), sums(1 << 20))


def test_suffix_tree_of_odd_rows(spark):
    df = odd_docs(spark)
    got = S.modelled(df, least_count=1).collect()
    assert len(got) == len(rows())
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (3, 4, 5))
    assert len({(r["base_score"], r["score"]) for r in got if r["doc_id"] == 8}) == 1
    assert sum(r["doc_id"] is None for r in got) == 2
    assert S.modelled(no_docs(spark)).count() == 0
    only_held_out = spark.createDataFrame([(i, "a b", "en", "s", 1) for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2], documents(spark).schema)
    assert {(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in S.modelled(only_held_out).collect()} == {(0, 0, 0.0, 0.0)}


# --- divergence tree ----------------------------------------------------------


def plain_audit(docs, least, top):
    count, with_term, groups = {}, {}, {}
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        own = Counter(found(TERM, text))
        groups.setdefault(lang, set()).add(source)
        count.setdefault((lang, source), Counter()).update(own)
        with_term.setdefault(lang, Counter()).update(own.keys())
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in with_term[lang].items() if n >= least]
        whole = sum((count[lang, s] for s in sources), Counter())

        def share(c):
            n = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + math.floor(Fraction(10**9 * (c[t] + 5), n)) for t in kept}

        q = share(whole)
        p = {s: share(count[lang, s]) for s in sources}
        for s in sources:
            parts = {
                "pair": [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s],
                "term": [(t, p[s][t] - q[t]) for t in kept if count[lang, s][t] > 0 and p[s][t] > q[t]],
            }
            for part, items in parts.items():
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, k) for k, (i, v) in enumerate(items, 1) if part == "pair" or k <= top]
    return sorted(out)


@pytest.mark.parametrize("least,block", [(1, 7), (3, 100), (30, 4096), (10**6, 50)])
def test_audit_equals_a_plain_loop(spark, least, block):
    docs = documents(spark).select("lang", "source", "text").unionByName(odd_docs(spark).select("lang", "source", "text"))
    got = sorted(map(tuple, D.audited(docs, least_docs=least, top=9, block=block).collect()))
    assert got == plain_audit([tuple(r) for r in docs.collect()], least, 9)


def test_tree_shares_beginnings():
    # Rows (a, b), (a, b, c), (a), (b, c): four beginnings of one, two and three items besides (b), (b, c).
    tree = D.PatternTree(np.array([0, 1, 0, 1, 2, 0, 1, 2]), np.array([2, 3, 1, 2]))
    assert len(tree.item) == 5 and sorted(tree.times.tolist()) == [1, 1, 1, 2, 3]
    assert [x.tolist() for x in tree.header()] == [[0, 1, 2], [3, 3, 2]]
    pairs = Counter()
    for item, above, times in tree.with_ancestors():
        for i, a, n in zip(item.tolist(), above.tolist(), times.tolist()):
            pairs[a, i] += n
    assert pairs == {(0, 1): 2, (1, 2): 2, (0, 2): 1}


def test_a_long_text_counts_as_one_document(spark, monkeypatch):
    long = spark.createDataFrame([("en", "s", "word " * 100), ("en", "t", "word other")], "lang string, source string, text string").coalesce(1)
    assert {(r["term"], r["n"], r["docs"]) for r in D.counted(long).collect()} == {("word", 100, 1), ("word", 1, 1), ("other", 1, 1)}
    big = spark.createDataFrame([("en", "s", "word " * 900_000)], "lang string, source string, text string")
    assert [(r["n"], r["docs"]) for r in D.counted(big).collect()] == [(900_000, 1)]


def test_audit_of_odd_rows(spark):
    assert D.audited(no_docs(spark)).count() == 0
    got = D.audited(odd_docs(spark), least_docs=10**6)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert {(r["part"], r["value"]) for r in got.collect()} == {("pair", 0)}


def test_shares_pass_sixty_four_bits(spark):
    n, total, kept = 4 * 10**12 + 1, 9 * 10**12 + 7, 10**6
    want = 1 + 10**9 * (n + 5) // (total + 5 * kept)
    from pyspark.sql import functions as F

    assert spark.range(1).select(D.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p")).first()["p"] == want == D.shares([n], [total], kept)[0]
