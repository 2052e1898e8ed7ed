"""From raw documents to sampled token ids: language, quality, near copies, source mix, segmentation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its output is written as Parquet and
read again before the next stage starts, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import fertility, langid, mixing, segment, setjoin
from tickloom.llm.common import scratch_path, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model tells with calibrated confidence stay."""
    return langid.keep_known(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie inside the fertility bands stay."""
    return fertility.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with five-word shingles 80 % alike, the one with the smallest id stays."""
    return setjoin.keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the target weights; a document comes once for each time the mix takes it."""
    return mixing.mixed_documents(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document of the mix."""
    return segment.encode(docs, k=2)


STAGES = [("language", language), ("quality", quality), ("near_copies", near_copies), ("mixture", mixture), ("segmentation", segmentation)]

#: No SQL: the stages train a model, run a tokenizer and sample.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
