"""The corpus pipeline: five stages from raw documents to packed token sequences.

Language identification, line dedup, near-duplicate removal, benchmark
decontamination, packing. Each stage works on all that the one before kept; its
result is written as Parquet in the shared folder and read again, so a lost
executor costs one stage's tasks and no plan spans two stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import line_windows, ppm_language, residual_packing, simhash_planes, winnow
from strandflow.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that get no language go: those without letters."""
    return ppm_language.in_known_languages(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of three lines or more stay once; texts of nothing else go."""
    return line_windows.without_emptied(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints link, the one with the smallest id stays."""
    return simhash_planes.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share ten consecutive words with a benchmark item go."""
    return winnow.clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces placed in sequences of 1024 tokens."""
    return residual_packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The language model, fingerprints and token ids are beyond SQL; the tests replay each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
