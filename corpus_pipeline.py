"""A corpus from raw documents to token ids: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetvitals.llm.bpe import round_trip
from fleetvitals.llm.exact import drop_copies
from fleetvitals.llm.minhash import drop_near_copies
from fleetvitals.llm.mixing import mix
from fleetvitals.llm.toxicity import drop_toxic, train_toxicity
from fleetvitals.plans import scratch_path, tune


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    labels = tune(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return drop_toxic(docs, train_toxicity(docs, labels))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    tune(spark)
    return drop_copies(docs, keep="smallest")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles with a similarity of 0.8."""
    tune(spark)
    return drop_near_copies(docs, width=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    tune(spark)
    return mix(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of the mixture, encoded and decoded again."""
    tune(spark)
    return round_trip(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("tokenize", tokenize),
]

# A trained classifier and a tokenizer are no SQL; tests/llm/test_whole.py holds the rows against a plain-Python chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written below the work folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
