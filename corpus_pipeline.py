"""A corpus pipeline: each stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelframe.llm import decontaminate, near_dedup, secrets, sentencepiece_sampling, toxicity
from reelframe.llm.common import Scratch, spread


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go."""
    labels = toxicity.chain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, toxicity.train(docs, labels, toxicity.CATEGORIES))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's sampled pieces, with the columns that name it; the pieces decode to the text."""
    return sentencepiece_sampling.encode(docs).select("doc_id", "lang", "source", "n_chars", "pieces", "lossless")


STAGES = [("toxicity_chain", toxicity_chain), ("minhash_near_dedup", minhash_near_dedup), ("benchmark_decontamination", benchmark_decontamination), ("secret_scan", secret_scan), ("sentencepiece_encoding", sentencepiece_encoding)]

#: Sampling and trained models are not SQL; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder before the next one reads it."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    before = Scratch(spark)
    for name, stage in STAGES[:-1]:
        after = Scratch(spark)
        docs = after.written(stage(spark, docs, sf_dir), name)
        before.clear()
        before = after
    return STAGES[-1][1](spark, docs, sf_dir)
