from __future__ import annotations

import hashlib

import numpy as np
import pytest

from strandflow.operators.splits import kfold_splits, split_images


def ids(spark, n: int):
    return spark.createDataFrame([(f"slide{k:02d}",) for k in range(n, 0, -1)], "image_id string")


def parts(df) -> dict[str, set]:
    out: dict = {}
    for r in df.collect():
        out.setdefault(r["split"], set()).add(r["image_id"])
    return out


def test_recorded_split(spark):
    got = parts(split_images(ids(spark, 41), n_val=8, n_test=8, seed=0, recorded=True))
    # The recorded assignment of 41 slides with seed 0.
    assert got["val"] == {f"slide{k:02d}" for k in (2, 11, 12, 19, 21, 24, 29, 36)}
    assert got["test"] == {f"slide{k:02d}" for k in (3, 4, 5, 22, 25, 27, 28, 35)}
    assert len(got["train"]) == 25


def test_recorded_folds(spark):
    rows = kfold_splits(ids(spark, 41), n_folds=5, n_val=6, seed=0, recorded=True).collect()
    tested = [r["image_id"] for r in rows if r["split"] == "test"]
    assert len(tested) == 41 == len(set(tested))
    order = np.random.default_rng(0).permutation(41)
    names = np.array(sorted(f"slide{k:02d}" for k in range(1, 42)))[order]
    for fold in range(5):
        test = set(names[fold::5])
        rest = [n for n in names if n not in test]
        val = {rest[j] for j in np.random.default_rng(1 + fold).permutation(len(rest))[:6]}
        mine = {r["image_id"]: r["split"] for r in rows if r["fold"] == fold}
        assert {k for k, v in mine.items() if v == "test"} == test
        assert {k for k, v in mine.items() if v == "val"} == val and len(mine) == 41


def ordered(names, seed: int) -> list[str]:
    return sorted(names, key=lambda x: (hashlib.md5(f"{seed}:{x}".encode()).hexdigest(), x))


def test_split_by_hash(spark):
    names = [f"slide{k:02d}" for k in range(1, 42)]
    twice = ids(spark, 41).union(ids(spark, 10))
    got = parts(split_images(twice, n_val=8, n_test=5, seed=3))
    order = ordered(names, 3)
    assert got == {"test": set(order[:5]), "val": set(order[5:13]), "train": set(order[13:])}
    assert got == parts(split_images(twice.repartition(7), n_val=8, n_test=5, seed=3))


def test_folds_by_hash(spark):
    names = [f"slide{k:02d}" for k in range(1, 42)]
    rows = kfold_splits(ids(spark, 41), n_folds=5, n_val=6, seed=2).collect()
    assert sorted(r["image_id"] for r in rows if r["split"] == "test") == names
    for fold in range(5):
        test = ordered(names, 2)[fold::5]
        val = ordered(set(names) - set(test), 3 + fold)[:6]
        mine = {r["image_id"]: r["split"] for r in rows if r["fold"] == fold}
        assert {k for k, v in mine.items() if v == "test"} == set(test) and {k for k, v in mine.items() if v == "val"} == set(val)
        assert len(mine) == 41


def test_errors(spark):
    few = ids(spark, 5)
    for call in (
        lambda: split_images(few, n_val=3, n_test=2),
        lambda: kfold_splits(few, n_folds=1),
        lambda: kfold_splits(few, n_folds=6),
        lambda: kfold_splits(few, n_folds=2, n_val=2),
    ):
        with pytest.raises(ValueError):
            call()
