from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandflow.functions.blossom import heaviest_pairs
from strandflow.operators.graph import chain_pieces, connected_components, greedy_pairs
from strandflow.operators.junctions import admissible_pairs, pair_ends
from strandflow.operators.matching import _assign, match_curves


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, size=(170, 2))]
    edges += [(1000 + k, 1001 + k) for k in range(40)] + [(5000, 5000)]
    parent = {n: n for e in edges for n in e}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {n: root(n) for n in parent}


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(1)
    pairs = {(int(a), int(b)): float(rng.random()) for a, b in rng.integers(0, 25, size=(90, 2)) if a < b}
    df = spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "a long, b long, w double")
    got = {(r["a"], r["b"]) for r in greedy_pairs(df, "a", "b", F.struct("w", "a", "b")).collect()}
    used, want = set(), set()
    for (a, b), _ in sorted(pairs.items(), key=lambda kv: (kv[1], kv[0])):
        if not {a, b} & used:
            want.add((a, b))
            used |= {a, b}
    assert got == want


def test_chains(spark):
    # 0-1-2 open with piece 1 turned round; 3-4-5 a loop; 6 alone; 7-8 joined start to start.
    links = [(1, 3), (2, 4), (7, 8), (9, 10), (11, 6), (14, 16)]
    pieces = spark.createDataFrame([(p,) for p in range(9)], "piece long")
    got = chain_pieces(pieces, spark.createDataFrame(links, "a long, b long")).collect()
    chains: dict = {}
    for r in sorted(got, key=lambda r: (r["chain"], r["pos"])):
        chains.setdefault(r["chain"], []).append((r["piece"], r["flipped"]))
    assert chains[0] == [(0, False), (1, True), (2, False)]
    assert chains[6] == [(3, False), (4, False), (5, False)]
    assert chains[12] == [(6, False)]
    assert chains[15] == [(7, True), (8, False)]


def test_long_chain(spark):
    n = 37
    links = [(2 * k + 1, 2 * k + 2) for k in range(n - 1)]
    pieces = spark.range(n).withColumnRenamed("id", "piece")
    got = chain_pieces(pieces, spark.createDataFrame(links, "a long, b long")).collect()
    assert {(r["chain"], r["pos"], r["piece"]) for r in got} == {(0, k, k) for k in range(n)}


def test_pairing_is_the_best(spark):
    rng = np.random.default_rng(2)
    rows, want = [], {}
    for node in range(12):
        k = int(rng.integers(2, 8))
        ends = [100 * node + 2 * i for i in range(k)]
        angle = rng.uniform(0, 2 * np.pi, k)
        rows += [(node, e, float(np.cos(a)), float(np.sin(a))) for e, a in zip(ends, angle)]
        cos = {(i, j): -np.cos(angle[i] - angle[j]) for i in range(k) for j in range(i + 1, k)}
        good = {p: (c - 0.5) / 0.5 for p, c in cos.items() if c >= 0.5}
        best = 0.0
        for size in range(k // 2 + 1):
            for pick in itertools.combinations(good, size):
                if len({v for p in pick for v in p}) == 2 * size:
                    best = max(best, sum(good[p] for p in pick))
        want[node] = best
    df = spark.createDataFrame(rows, "node long, end long, dx double, dy double")
    pairs = pair_ends(df, ["node"])
    quality = admissible_pairs(df, ["node"])
    got = pairs.join(quality, ["a", "b"]).groupBy("node").agg(F.sum("quality").alias("q")).collect()
    found = {r["node"]: r["q"] for r in got}
    for node, best in want.items():
        assert abs(found.get(node, 0.0) - best) < 1e-9


@pytest.mark.parametrize("top", [1, 5, 10**12])
def test_blossoms_against_all_pairings(top):
    rng = np.random.default_rng(top)

    def best(left: frozenset, w: dict) -> int:
        if not left:
            return 0
        a = min(left)
        rest = left - {a}
        return max([best(rest, w), *[w[a, b] + best(rest - {b}, w) for b in rest if (a, b) in w]])

    for _ in range(150):
        n = int(rng.integers(2, 10))
        w = {(a, b): int(rng.integers(1, top + 1)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.6}
        got = heaviest_pairs([(a, b, x) for (a, b), x in w.items()])
        assert len({v for p in got for v in p}) == 2 * len(got)
        assert sum(w[p] for p in got) == best(frozenset(range(n)), w)


def test_node_of_many_ends_is_paired_best(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for node, k in enumerate((9, 12, 16)):
        angle = rng.uniform(0, 2 * np.pi, k)
        rows += [(node, 100 * node + 2 * i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(angle)]
        good = {(i, j): (-np.cos(angle[i] - angle[j]) - 0.5) / 0.5 for i in range(k) for j in range(i + 1, k) if -np.cos(angle[i] - angle[j]) > 0.5}
        table = {0: 0.0}
        for mask in range(1, 1 << k):
            low = (mask & -mask).bit_length() - 1
            rest = mask ^ (1 << low)
            table[mask] = max([table[rest], *[good[low, j] + table[rest ^ (1 << j)] for j in range(low + 1, k) if rest >> j & 1 and (low, j) in good]])
        want[node] = table[(1 << k) - 1]
    df = spark.createDataFrame(rows, "node long, end long, dx double, dy double")
    got = pair_ends(df, ["node"]).join(admissible_pairs(df, ["node"]), ["a", "b"]).groupBy("node").agg(F.sum("quality").alias("q")).collect()
    assert {r["node"]: pytest.approx(r["q"], abs=1e-9) for r in got} == want
    greedy = pair_ends(df, ["node"], greedy_above=8).join(admissible_pairs(df, ["node"]), ["a", "b"]).agg(F.sum("quality")).first()[0]
    assert greedy <= sum(want.values()) + 1e-9


def test_crowded_node_is_greedy(spark):
    angle = [0.0, np.pi, 0.1, np.pi + 0.3, 1.0, 2.0, 2.2, 4.0, 5.0, 5.5]
    rows = [(1, 2 * i, float(np.cos(a)), float(np.sin(a))) for i, a in enumerate(angle)]
    df = spark.createDataFrame(rows, "node long, end long, dx double, dy double")
    pairs = {(r["a"], r["b"]) for r in pair_ends(df, ["node"]).collect()}
    assert (0, 2) in pairs
    assert len({e for p in pairs for e in p}) == 2 * len(pairs)


def brute_assignment(cost: dict) -> tuple[int, float]:
    best = (0, 0.0)
    edges = list(cost)
    for size in range(1, min(len({a for a, _ in edges}), len({b for _, b in edges})) + 1):
        totals = [
            sum(cost[e] for e in pick)
            for pick in itertools.combinations(edges, size)
            if len({a for a, _ in pick}) == size == len({b for _, b in pick})
        ]
        if totals:
            best = (size, min(totals))
    return best


def test_assignment_against_enumeration(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for image in range(25):
        n, m = rng.integers(1, 5, size=2)
        cost = {(i, j): float(rng.random()) for i in range(n) for j in range(m) if rng.random() < 0.6}
        if not cost:
            continue
        want[image] = brute_assignment(cost)
        rows += [(image, i, j, c) for (i, j), c in cost.items()]
        e = list(cost)
        chosen = _assign(np.array([a for a, _ in e]), np.array([b for _, b in e]), np.array([cost[k] for k in e]))
        assert len(chosen) == want[image][0]
    df = spark.createDataFrame(rows, "image_id long, p long, g long, distance double")
    got = match_curves(df, image=["image_id"], ida="p", idb="g").groupBy("image_id").agg(
        F.count("*").alias("n"), F.sum("distance").alias("d"), F.countDistinct("p").alias("np"), F.countDistinct("g").alias("ng")
    )
    for r in got.collect():
        assert (r["n"], r["np"], r["ng"]) == (want[r["image_id"]][0],) * 3
        assert abs(r["d"] - want[r["image_id"]][1]) < 1e-9


def test_more_pairs_beat_less_distance(spark):
    # Taking the cheap middle edge would leave the other two curves alone.
    rows = [(1, 0, 0, 1.0), (1, 0, 1, 10.0), (1, 1, 0, 10.0)]
    df = spark.createDataFrame(rows, "image_id long, p long, g long, distance double")
    assert match_curves(df, image=["image_id"], ida="p", idb="g").count() == 2
