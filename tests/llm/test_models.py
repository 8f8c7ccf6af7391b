from __future__ import annotations

import sys
import zlib
from math import log2
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import LONG, documents, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import ppm_language as P  # noqa: E402
from strandflow.llm import toxicity_gru as T  # noqa: E402


# --- language ---------------------------------------------------------------


def plain_counts(texts):
    out = {}
    for t in texts:
        raw = P.plain(t)
        for i, b in enumerate(raw):
            for n in range(min(P.ORDER, i) + 1):
                out.setdefault(raw[i - n : i], {}).setdefault(b, 0)
                out[raw[i - n : i]][b] += 1
    return out


def plain_length(counts, text, known):
    """Bits of a text; ``known`` holds the counts of all languages, whose strings make the tree."""
    raw, bits = P.plain(text), 0.0
    for i, b in enumerate(raw):
        for n in range(min(P.ORDER, i), -1, -1):
            seen = counts.get(raw[i - n : i])
            if seen:
                total = sum(seen.values())
                if b in seen:
                    bits -= log2(seen[b] / (total + len(seen)))
                    break
                bits -= log2(len(seen) / (total + len(seen)))
        else:
            bits += 8
    return bits


def test_code_lengths_are_those_of_the_model(spark):
    train = [("en", "the cat sat on the mat"), ("en", "the hat"), ("fr", "le chat sur la table"), ("fr", "été ça")]
    tree = P.train(spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(train)], "doc_id long, text string, lang string"))
    assert tree.languages == ["en", "fr"]
    counts = {x: plain_counts([t for y, t in train if y == x]) for x in tree.languages}
    texts = ["the chat", "q", "été the", "  ", "zzzzz le la"]
    got = tree.code_lengths([P.plain(t) for t in texts])
    want = [[plain_length(counts[x], t, counts) for x in tree.languages] for t in texts]
    assert np.allclose(got, want, rtol=1e-5)


def test_held_out_languages(spark):
    got = P.identified(documents(spark)).join(documents(spark).select("doc_id", "lang"), "doc_id").toPandas()
    assert got["held_out"].tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]
    own = got[got["held_out"]]
    assert (own["lang_pred"] == own["lang"]).mean() > 0.98 and got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    df = odd_docs(spark)
    got = P.identified(df).collect()
    assert len(got) == len(rows())
    lang = {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] is not None}
    assert all(lang[i] == "und" for i in (3, 4, 5, 7)) and lang[1] == "en" and lang[12] == "fr" and lang[6] == "en"
    assert all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    kept = P.in_known_languages(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} >= {1, 2, 6, 8, 9, 12} and not {r["doc_id"] for r in kept.collect()} & {3, 4, 5, 7}
    assert P.identified(no_docs(spark)).count() == 0 and P.in_known_languages(no_docs(spark)).count() == 0
    unlabelled = df.withColumn("lang", df["lang"].substr(9, 1)).replace("", None, subset=["lang"])
    assert {r["lang_pred"] for r in P.identified(unlabelled).collect()} == {"und"}


def test_the_tree_stays_closed_when_cut(spark):
    tree = P.train(documents(spark), max_nodes=500)
    for n in range(1, len(tree.grams)):
        assert np.isin(tree.grams[n] >> 8, tree.grams[n - 1]).all()
        assert np.isin(tree.grams[n] & ((1 << 8 * n) - 1), tree.grams[n - 1]).all()
    assert sum(map(len, tree.grams)) == 500


def test_every_label_is_learned(spark):
    # 70 languages, each with words of its own; the last has one labelled text of a few words.
    words = [[f"{a}{b}{c}{a}" for a in x for b in "aeiou" for c in x] for x in ("".join(np.random.default_rng(i).choice(list("bcdfghjklmnpqrstvwxz"), 4, replace=False)) for i in range(70))]
    text = lambda i, n: " ".join(np.random.default_rng([i, n]).choice(words[i], 6 if i == 69 else 60))
    train = [(100 * i + n, text(i, n), f"l{i:02d}") for i in range(70) for n in range(1 if i == 69 else 3)]
    tree = P.train(spark.createDataFrame(train, "doc_id long, text string, lang string"), language_nodes=3000)
    assert tree.every_language == [f"l{i:02d}" for i in range(70)] and len(tree.languages) == P.TURN
    got, _, _ = P.verdicts(tree, [text(i, 9) for i in range(70)])
    assert got == tree.every_language


# --- toxicity -----------------------------------------------------------------


def test_gradients_are_those_of_the_loss():
    net = T.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    table, index, length = rng.normal(size=(9, 6 * T.HIDDEN)), rng.integers(0, 9, (4, 5)), np.array([5, 4, 4, 1])
    y = np.array([1.0, 0, 1, 0])

    def loss():
        logit = net.forward(table, index, length)[0]
        return float((np.logaddexp(0, logit) - y * logit).sum())

    logit, kept = net.forward(table, index, length, keep=True)
    g, d_table = net.backward(T.sigmoid(logit) - y, kept, index.shape)
    grad_table = np.zeros_like(table)
    np.add.at(grad_table, index.ravel(), d_table.reshape(-1, table.shape[1]))
    net_grads = {**{k: g[k] for k in ("rec_f", "rec_b", "att", "att_v", "out", "out_b")}, "table": grad_table}
    for name, grad in net_grads.items():
        value = table if name == "table" else net.p[name]
        for at in list(np.ndindex(value.shape))[:: max(1, value.size // 12)]:
            kept_value = value[at]
            value[at] = kept_value + 1e-3
            up = loss()
            value[at] = kept_value - 1e-3
            down = loss()
            value[at] = kept_value
            assert grad[at] == pytest.approx((up - down) / 2e-3, abs=3e-3), (name, at)


def test_windows_cover_every_word():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        text, first, length = T.cut([np.arange(n)])
        assert sorted({w for f, k in zip(first, length) for w in range(f, f + k)}) == list(range(n))
        assert (length <= T.WINDOW).all() and (np.diff(first) == T.STRIDE).all()


@pytest.fixture(scope="module")
def network():
    rng = np.random.default_rng(5)
    calm = ["house", "garden", "river", "summer", "winter", "apple", "bread", "walked", "quiet", "morning"]
    texts, labels = [], []
    for i in range(300):
        w = rng.choice(calm, 150).tolist()
        if i % 2:
            for at in rng.integers(0, 150, 3):
                w[at] = "vile" + rng.choice(["ness", "ly", "st", ""])
        texts.append(" ".join(w))
        labels.append(i % 2)
    return T.fit(texts, np.array(labels))


def test_one_word_anywhere_counts(network):
    texts = T.Texts(network)
    calm = ["river"] * 3000
    far = calm.copy()
    far[2900] = "vilely"
    unseen = [*calm[:40], "vileish", *calm[:40]]
    value = T.text_scores(network, texts, [" ".join(calm), " ".join(far), " ".join(unseen), "", "river", "vileness"])
    assert value[0] < 0.5 < min(value[1], value[2], value[5]) and value[3] == 0 and value[4] < 0.5


def test_scores_do_not_depend_on_the_batch(network):
    group = ["river vile house", "apple " * 200, LONG, "x", "", "vile"]
    one = np.concatenate([T.text_scores(network, T.Texts(network), [t]) for t in group])
    assert np.allclose(one, T.text_scores(network, T.Texts(network), group), atol=1e-5)


def test_toxicity_of_odd_rows(spark, network):
    df = odd_docs(spark)
    for model in (network, 0.0, 1.0):
        got = T.score(df, model).collect()
        assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    held = {r["doc_id"]: r["held_out"] for r in got}
    assert all(v == (zlib.crc32(str("" if k is None else k).encode()) % 5 == 0) for k, v in held.items())
    labels = spark.createDataFrame([(1, None, 1), (2, 1, None), (None, 1, 1), (99, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.scored(df, labels).filter("score <> 1").count() == 0
    assert T.scored(df, labels.limit(0)).filter("score <> 0").count() == 0
    both = spark.createDataFrame([(1, 1, 1), (2, 1, 0), (6, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
    assert T.scored(df, both).count() == len(rows()) and T.scored(no_docs(spark), both).count() == 0
