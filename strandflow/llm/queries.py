"""Named queries of the text operators over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandflow.llm import (
    divergence_tree,
    importance_draw,
    license_digest,
    line_windows,
    ppm_language,
    residual_packing,
    rule_ledger,
    simhash_planes,
    suffix_tree,
    token_store,
    toxicity_gru,
    warc_zip,
    winnow,
)
from strandflow.llm.common import table


def op1_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_language.identified(table(spark, sf_dir, "documents"))


def op2_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_windows.deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_documents(table(spark, sf_dir, "documents"))


def op4_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residual_packing.pack_documents(table(spark, sf_dir, "documents"))


def op5_license_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest.scanned(table(spark, sf_dir, "documents"))


def op6_simhash_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_planes.components(table(spark, sf_dir, "documents"))


def op7_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_gru.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_")


def op9_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ledger.judged(table(spark, sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.archived(table(spark, sf_dir, "pages"))


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.modelled(table(spark, sf_dir, "documents"))


def op13_divergence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_tree.audited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ppm_language": op1_ppm_language,
    "op2_line_windows": op2_line_windows,
    "op3_token_store": op3_token_store,
    "op4_residual_packing": op4_residual_packing,
    "op5_license_digest": op5_license_digest,
    "op6_simhash_planes": op6_simhash_planes,
    "op7_toxicity_gru": op7_toxicity_gru,
    "op8_winnow": op8_winnow,
    "op9_rule_ledger": op9_rule_ledger,
    "op10_warc_zip": op10_warc_zip,
    "op11_importance_draw": op11_importance_draw,
    "op12_suffix_tree": op12_suffix_tree,
    "op13_divergence_tree": op13_divergence_tree,
}

#: Token ids, learned models and archives are beyond SQL; the tests compare those queries with brute force.
ORACLE: dict[str, str] = {
    "op2_line_windows": line_windows.SQL,
    "op5_license_digest": license_digest.SQL,
    "op8_winnow": winnow.SQL,
    "op9_rule_ledger": rule_ledger.SQL,
    "op10_warc_zip": warc_zip.SQL,
    "op11_importance_draw": importance_draw.SQL,
    "op13_divergence_tree": divergence_tree.SQL,
}
