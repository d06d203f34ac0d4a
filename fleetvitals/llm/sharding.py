"""Shards that each have the mixture of the whole: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.llm.ranks import positions

SHARDS = 24
SEED = 20_240
# Buckets of a ranking: a bucket of 100 TB of documents has some millions of narrow rows.
BUCKET_BITS = 12


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """A shard and a gapless slot in it for every row of ``docs``.

    Rows are shuffled inside their source by a seeded hash and ranked; rank r of n has the fractional rank
    (2r + 1) / 2n; the rows of all sources are sorted by it and cut into ``shards`` runs whose lengths differ
    by one at most.  So each run holds its share of every source, to within one row.

    Columns: ``doc_id``, ``source``, ``size`` (UTF-8 bytes of the text plus 8), ``text_crc32``, ``shard``,
    ``slot``.  Only these narrow columns and the hash are shuffled, never texts.

    Null sources are a source of their own.  A null text has size 8 and the checksum of no bytes.  Ties of the
    hash fall to id, checksum and size; rows equal in all of these are interchangeable.  More shards than rows
    leave shards empty; no rows give no rows.
    """
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id"),
        F.col("source"),
        (F.octet_length(bytes_) + 8).cast("bigint").alias("size"),
        F.crc32(bytes_).alias("text_crc32"),
    )
    shuffled = rows.withColumn("_draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32")).withColumn(
        "_stratum", F.when(F.col("source").isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col("source")))
    )
    shuffled = shuffled.withColumn("_bucket", F.shiftright("_draw", 64 - BUCKET_BITS))
    ties = ["_draw", "doc_id", "text_crc32", "size"]
    ranked = positions(shuffled, ["_stratum"], "_bucket", ties)
    share = (2 * F.col("_position") + 1).cast("double") / (2 * F.col("_rows")).cast("double")
    ranked = ranked.withColumn("_share", share).drop("_position", "_rows", "_bucket")
    ranked = ranked.withColumn("_bucket", F.floor(F.col("_share") * F.lit(float(1 << BUCKET_BITS))))
    placed = positions(ranked, [], "_bucket", ["_share", "_stratum", *ties])
    shard = F.expr(f"_position * {int(shards)} div _rows")
    first = F.expr(f"(shard * _rows + {int(shards) - 1}) div {int(shards)}")
    return placed.withColumn("shard", shard).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.col("shard").cast("int").alias("shard"),
        (F.col("_position") - first).cast("bigint").alias("slot"),
    )


def sharding_query(documents: DataFrame) -> DataFrame:
    return interleaved_shards(documents).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source"
    )
