"""A corpus pipeline: each stage takes (spark, docs, sf_dir) and returns the rows that go on; the last encodes them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import bpe, decontam, quality, simhash, toxicity
from vexel.plans.storage import TEXT_GROUP, materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic; the lexicon is learned from the labelled documents of the whole table."""
    model = toxicity.learn(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.remove_matched(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of each document's tokens and of the text decoded from them."""
    return bpe.digests(docs)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("near-dedup", near_dedup), ("decontamination", decontaminate), ("bpe", encode)]

#: Stages learn, hash and tokenize in ways that SQL has no words for; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), TEXT_GROUP)
    return STAGES[-1][1](spark, docs, sf_dir)
