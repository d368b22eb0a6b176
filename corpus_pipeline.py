"""The corpus pipeline: five stages over documents, each a Spark job on what the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathom.llm import bpe, decontaminate, exact_dedup, near_dedup, quality
from fathom.plans.scratch import Scratch
from fathom.sources.tables import table

#: A batch of whole rows is held by the JVM and by its Python worker, at the same time and for every core.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, unless it has a bound already. Narrow rows keep their batches of 10,000."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    small_batches(spark)
    return quality.accepted(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text stays."""
    return exact_dedup.survivors(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.8 or more."""
    small_batches(spark)
    return near_dedup.survivors(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    small_batches(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with their digests."""
    small_batches(spark)
    return bpe.tokens(docs)


STAGES = [
    ("quality", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: The classifier and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; what each returns is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, name.replace(" ", "-"))
    return docs
