"""A bounded sample of labelled rows to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Labelled rows a classifier is fitted on, at most.
SAMPLE_ROWS = 12_000


def fold(doc_id: Column, folds: int) -> Column:
    """The remainder of the checksum of an id's decimal text."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(labels: DataFrame, target: str, folds: int, held_out: int, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``_id`` and ``_label`` (0 or 1) of ``rows`` labelled ids at most, chosen by hash, none of them held out.

    Null ids and null labels are left out; of an id with several labels the greatest counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull()).where(fold(F.col("doc_id"), folds) != held_out)
    one = usable.groupBy(F.col("doc_id").alias("_id")).agg((F.max(target) > 0).cast("int").alias("_label"))
    return one.orderBy(F.xxhash64(F.lit("sample"), "_id"), "_id").limit(rows)


def sample_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``_label`` and ``_text`` of the sampled ids, one row for each, so as few as the sample; the broadcast list is as short.

    Of the texts of a repeated id the one of least hash counts, found in each task before anything is shuffled.
    """
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    met = texts.join(F.broadcast(sample), "_id")
    one = met.groupBy("_id", "_label").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return one.select("_label", "_text")
