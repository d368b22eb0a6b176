"""One query for each operator, over the whole of its tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, decontaminate, exact_dedup, extract, fingerprint, hard_negatives, near_dedup, prefix_trie, quality, secrets, substring_dedup, toxicity, warc
from fathom.sources.tables import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.main_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), size=4, percent=80)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mined(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_secret_scan, op2_extract, op3_near_dedup, op4_exact_dedup, op5_decontaminate, op6_substring_dedup, op7_quality, op8_warc, op9_bpe, op10_toxicity, op11_hard_negatives, op12_prefix_trie, op13_fingerprint)}


def oracle_sql() -> dict[str, str]:
    return {"op1_secret_scan": secrets.ORACLE_SQL, "op4_exact_dedup": exact_dedup.ORACLE_SQL, "op5_decontaminate": decontaminate.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL, "op11_hard_negatives": hard_negatives.ORACLE_SQL, "op12_prefix_trie": prefix_trie.ORACLE_SQL, "op13_fingerprint": fingerprint.ORACLE_SQL}
