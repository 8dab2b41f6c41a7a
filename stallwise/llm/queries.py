"""The queries of the operators in this folder, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from stallwise.llm import brown, cover, decontamination, dual_tree, mixing, pii, prefix_trie, quality, secret_scan, suffix, tokens, topk, trie
from stallwise.llm.folders import new_folder
from stallwise.llm.shipping import ship

SQL_FOLDER = Path(__file__).resolve().parent / "sql"
Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def op1_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie.linked_documents(table(spark, folder, "documents"))


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search_report(table(spark, folder, "embeddings"))


def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_suffix(spark: SparkSession, folder: str) -> DataFrame:
    return suffix.duplicate_bytes(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_tokens(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), files)
    return tokens.token_report(spark, files)


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pii_report(table(spark, folder, "documents"))


def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secret_report(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_report(table(spark, folder, "documents"))


def op10_cover(spark: SparkSession, folder: str) -> DataFrame:
    return cover.duplicate_words(table(spark, folder, "documents"))


def op11_brown(spark: SparkSession, folder: str) -> DataFrame:
    return brown.language_report(table(spark, folder, "documents"))


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.prefix_report(table(spark, folder, "conversations"))


def op13_dual_tree(spark: SparkSession, folder: str) -> DataFrame:
    return dual_tree.code_report(table(spark, folder, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_trie": op1_trie,
    "op2_topk": op2_topk,
    "op3_decontamination": op3_decontamination,
    "op4_suffix": op4_suffix,
    "op5_quality": op5_quality,
    "op6_tokens": op6_tokens,
    "op7_pii": op7_pii,
    "op8_secrets": op8_secrets,
    "op9_mixing": op9_mixing,
    "op10_cover": op10_cover,
    "op11_brown": op11_brown,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_dual_tree": op13_dual_tree,
    "pipeline": corpus_pipeline.run,
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {path.stem: path.read_text(encoding="utf-8") for path in sorted(SQL_FOLDER.glob("*.sql"))}
