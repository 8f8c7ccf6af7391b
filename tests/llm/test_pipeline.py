"""Each stage of the pipeline against a replay of its decision on the same input."""

from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
from cases import SF, documents, no_docs, odd_docs  # noqa: E402
from test_lines_and_leaks import by_lines, by_words  # noqa: E402
from test_simhash import by_pairs, plain_fingerprint  # noqa: E402

import corpus_pipeline  # noqa: E402
from strandflow.llm.common import written  # noqa: E402
from strandflow.llm.ppm_language import has_letter  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def states(spark):
    """The rows before the first stage and after each stage."""
    docs, out = documents(spark), []
    out.append(docs.toPandas())
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        out.append(docs.toPandas())
    return out


def pairs(df):
    return [(int(a), b) for a, b in zip(df["doc_id"], df["text"])]


def test_stages_are_the_dealt_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "packing"]


def test_columns_stay_those_of_documents(states):
    assert all(list(s.columns) == COLUMNS for s in states[:-1])


def test_language(states):
    assert set(pairs(states[1])) == {(i, t) for i, t in pairs(states[0]) if t and has_letter(t)}


def test_lines(states):
    want = by_lines(pairs(states[1]))
    assert sorted(pairs(states[2])) == sorted((i, w[0]) for (i, _), w in want.items() if w[2] == 0 or w[2] < w[1])


def test_near_duplicates(states):
    before = states[2].sort_values("doc_id")
    root = by_pairs(np.array([plain_fingerprint(t) for t in before["text"]], dtype=np.uint64))
    assert sorted(pairs(states[3])) == sorted(pairs(before[root == np.arange(len(root))]))


def test_decontamination(spark, states):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in by_words(pairs(states[3]), items) if r[5]}
    assert bad and sorted(pairs(states[4])) == sorted(p for p in pairs(states[3]) if p[0] not in bad)


def test_packing(states):
    packed = states[5]
    assert set(packed["doc_id"]) == set(states[4]["doc_id"])
    fill = packed.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 1024 and len(fill) <= 1.03 * packed["length"].sum() / 1024 + 1


def test_run(spark, states):
    assert corpus_pipeline.run(spark, SF).count() == len(states[5])


@pytest.mark.parametrize("make", [odd_docs, no_docs])
def test_odd_tables_go_through(spark, make):
    docs = make(spark)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, SF), name)
        assert docs.columns == columns
    assert (corpus_pipeline.packing(spark, docs, SF).count() > 0) == (make is odd_docs)
