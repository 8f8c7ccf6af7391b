"""Train / validation / test assignment by image.

Images are put in the order of a seeded hash of their ids and cut by rank; the
ranking is a distributed sort, and no task knows more than its own rows. A split
that was recorded with NumPy's seeded permutation can be had again with
``recorded=True``; each task then holds the permutation of all ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandflow.operators.numbering import number_rows


def sorted_rank(ids: DataFrame, id_col: str) -> DataFrame:
    """0-based rank of each distinct id in ascending order, and the number of ids."""
    distinct = ids.select(id_col).distinct()
    ranked = number_rows(distinct, [], [id_col], "rank")
    return ranked.withColumn("n", F.lit(ranked.count()).cast("long"))


def _permuted(ranked: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Adds ``place``: where the seeded permutation of n puts each rank."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        where: np.ndarray | None = None
        for pdf in batches:
            if len(pdf) and where is None:
                n = int(pdf["n"].iloc[0])
                where = np.empty(n, dtype=np.int64)
                where[np.random.default_rng(seed).permutation(n)] = np.arange(n)
            if len(pdf):
                yield pdf.assign(place=where[pdf["rank"].to_numpy()])

    schema = ranked.schema.simpleString()[len("struct<") : -1]
    return ranked.mapInPandas(place, schema + ",place:bigint")


def hashed(id_col: str, seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")))


def placed_by_hash(ids: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``id, place``: each distinct id's rank in the order of its seeded hash."""
    keyed = ids.select(id_col).distinct().withColumn("hash", hashed(id_col, seed))
    return number_rows(keyed, [], ["hash", id_col], "place").drop("hash")


def split_images(
    ids: DataFrame, id_col: str = "image_id", *, n_val: int, n_test: int = 0, seed: int = 0, recorded: bool = False
) -> DataFrame:
    """``id, split``: test images first in the order, then val, then train."""
    placed = _permuted(sorted_rank(ids, id_col), id_col, seed) if recorded else placed_by_hash(ids, id_col, seed)
    n = placed.count()
    if n_val + n_test >= n:
        raise ValueError(f"{n} images cannot give {n_test} test and {n_val} validation images and still train")
    place = F.col("place")
    return placed.select(
        id_col,
        F.when(place < n_test, "test").when(place < n_test + n_val, "val").otherwise("train").alias("split"),
    )


def kfold_splits(
    ids: DataFrame, id_col: str = "image_id", *, n_folds: int = 5, n_val: int = 6, seed: int = 0, recorded: bool = False
) -> DataFrame:
    """``fold, id, split`` with every image in ``test`` of exactly one fold.

    Test blocks are every n_folds-th image of the order; each fold ranks the rest
    afresh, by a hash with a seed of its own, for its validation images.
    """
    if n_folds < 2:
        raise ValueError("one fold has nothing to train on: n_folds starts at 2")
    placed = _permuted(sorted_rank(ids, id_col), id_col, seed) if recorded else placed_by_hash(ids, id_col, seed)
    n = placed.count()
    if n_folds > n:
        raise ValueError(f"{n} images do not fill {n_folds} folds")
    if n_val >= n - -(-n // n_folds):
        raise ValueError(f"a fold with {n_val} validation images has none left to train on")
    if recorded:
        return _recorded_folds(placed, id_col, n, n_folds, n_val, seed)
    folds = placed.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1))))
    test = F.col("place") % n_folds == F.col("fold")
    rest = folds.filter(~test).withColumn("hash", F.md5(F.concat_ws(":", F.col("fold") + (seed + 1), F.col(id_col).cast("string"))))
    ranked = number_rows(rest, ["fold"], ["hash", id_col], "rank")
    return (
        folds.filter(test)
        .select("fold", id_col, F.lit("test").alias("split"))
        .unionByName(ranked.select("fold", id_col, F.when(F.col("rank") < n_val, "val").otherwise("train").alias("split")))
    )


def _recorded_folds(placed: DataFrame, id_col: str, n: int, n_folds: int, n_val: int, seed: int) -> DataFrame:

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        val_rank: dict[int, np.ndarray] = {}
        for pdf in batches:
            place = pdf["place"].to_numpy()
            for fold in range(n_folds):
                if fold not in val_rank:
                    rest = n - len(range(fold, n, n_folds))
                    order = np.random.default_rng(seed + 1 + fold).permutation(rest)
                    inverse = np.empty(rest, dtype=np.int64)
                    inverse[order] = np.arange(rest)
                    val_rank[fold] = inverse
                test = place % n_folds == fold
                # Place among the images that remain once this fold's are taken out.
                rest_place = place - (place - fold + n_folds - 1) // n_folds
                rest_place = np.where(test, 0, np.maximum(rest_place, 0))
                is_val = val_rank[fold][rest_place] < n_val
                split = np.where(test, "test", np.where(is_val, "val", "train"))
                yield pd.DataFrame({"fold": fold, id_col: pdf[id_col], "split": split})

    id_type = placed.schema[id_col].dataType.simpleString()
    return placed.mapInPandas(assign, f"fold int, {id_col} {id_type}, split string")
