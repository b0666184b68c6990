"""A corpus pipeline: toxic documents go, one of each group of near copies stays, documents with benchmark passages go,
sources are mixed to their target weights, and what is left is dealt to shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideweave.llm import decontaminate, jaccard, mixing, sharding, toxicity
from tideweave.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that a model of the labelled ones rejects."""
    return toxicity.clean(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return jaccard.one_of_each(docs, n=5, percent=80)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold passages of benchmark items."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row for each document and pass."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of each document."""
    return sharding.shard(docs)


STAGES = [("toxicity", toxic), ("near_copies", near_copies), ("decontamination", benchmark_passages), ("mix", mix), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained model and a pseudorandom mix aren't expressible in SQL; the tests compare with plain Python.
ORACLE_SQL = None
