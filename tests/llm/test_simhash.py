from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from cases import documents, no_docs, odd_docs, rows  # noqa: E402

from strandflow.llm import simhash_planes as S  # noqa: E402


def plain_fingerprint(text) -> int:
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def by_pairs(prints: np.ndarray) -> np.ndarray:
    """The smallest position each one reaches, by all pairs."""
    root = np.arange(len(prints))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= S.RADIUS
    while True:
        new = np.where(near, root[None, :], len(prints)).min(axis=1)
        if (new == root).all():
            return root
        root = new


def clustered(n: int, seed: int = 0, centres: int = 9) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = rng.integers(0, 1 << 63, centres, dtype=np.uint64) * 2 + 1
    out = centre[rng.integers(0, centres, n)]
    for _ in range(7):
        flip = rng.random(n) < 0.7
        out = np.where(flip, out ^ (np.uint64(1) << rng.integers(0, 64, n, dtype=np.uint64)), out)
    return np.unique(out)


@pytest.mark.parametrize("n", [1, 63, 64, 65, 700])
def test_planes_find_what_popcount_finds(n):
    fps = clustered(n, n)
    group = np.sort(np.random.default_rng(n).integers(0, 3, len(fps)))
    planes = S.Planes(fps, group)
    root = S.smallest_linked(planes)
    for g in np.unique(group):
        own = np.flatnonzero(group == g)
        assert (root[own] == own[by_pairs(fps[own])]).all()


def test_each_distance_is_told():
    fps = np.array([0] + [(1 << k) - 1 for k in range(1, 65)], dtype=np.uint64)
    planes = S.Planes(fps, np.zeros(65, dtype=int))
    a, b = planes.near(np.zeros(2, dtype=int), np.array([0, 1]))
    assert sorted(b.tolist()) == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("block", [16, 4096])
def test_links_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK", block)
    fps = clustered(1500, 5)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    edges = S.links(df).distinct().collect()
    place = {int(x): i for i, x in enumerate(fps.view(np.int64))}
    root = np.arange(len(fps))
    S.join_roots(root, np.array([place[r["src"]] for r in edges]), np.array([place[r["dst"]] for r in edges]))
    assert (S.settled(root) == by_pairs(fps)).all()
    linked = np.bitwise_count(fps[[place[r["src"]] for r in edges]] ^ fps[[place[r["dst"]] for r in edges]])
    assert len(edges) < 20 * len(fps) and linked.max() <= 64


def test_components_equal_brute_force(spark):
    docs = documents(spark)
    got = S.components(docs).toPandas().set_index("doc_id").sort_index()
    want = docs.toPandas().set_index("doc_id").sort_index()
    prints = np.array([plain_fingerprint(t) for t in want["text"]], dtype=np.uint64)
    assert got["fingerprint"].tolist() == [f"{int(f):016x}" for f in prints]
    ids = want.index.to_numpy()
    assert got["component_id"].tolist() == ids[by_pairs(prints)].tolist()


def test_odd_rows(spark):
    df = odd_docs(spark)
    got = S.components(df).collect()
    assert len(got) == len(rows())
    part = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    empty = [3, 4, 5]
    assert {part[i] for i in empty} == {3} and part[9] == 8 and part[1] == 1
    assert sorted(r["component_id"] for r in got if r["doc_id"] is None) == [1, 3]
    assert {r["fingerprint"] for r in got if r["doc_id"] in empty} == {"0" * 16}
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v for v in part.values()})
    assert S.components(no_docs(spark)).count() == 0 and S.one_of_each(no_docs(spark)).count() == 0
    nameless = df.filter("doc_id IS NULL AND text IS NULL")
    assert S.components(nameless).first()["component_id"] is None and S.one_of_each(nameless).count() == 1
