"""Exact duplicates: groups of equal texts, found by content hash and confirmed on the bytes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEEP = {"largest": F.max, "smallest": F.min}


def _digest(text: Column) -> Column:
    """128 bits of content hash."""
    return F.unhex(F.md5(text))


def copy_groups(docs: DataFrame, keep: str = "largest", carry: Sequence[str] = ()) -> DataFrame:
    """Each row with the group of equal texts it belongs to.

    Columns: ``doc_id``, ``keep_id`` (the largest or smallest id of the group), ``group_size``, ``kept``,
    ``text_sha256`` (lower-case hex of the UTF-8 text), and the columns named in ``carry``.

    Rows are counted by a 128-bit content hash, combined inside the input tasks, so a group that holds a
    third of the table is a few rows in the shuffle.  Only texts whose hash occurs twice are read again and
    grouped by the text itself: there the bytes are compared, and texts that merely share a hash part.  Rows
    return to their group by content hash and SHA-256 together; that join's fact side may be split at will.

    A null text counts as empty.  A null id is below every id: it is kept only when the whole group has
    none.  A row that repeats both id and text counts in ``group_size`` and has the same values.  No rows
    give no rows.  Other columns are not looked at, whatever their names.
    """
    carried = [F.col(f"`{name}`").alias(f"_carry{i}") for i, name in enumerate(carry)]
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").alias("_id"), _digest(body).alias("_hash"), F.sha2(body, 256).alias("_sha"), *carried
    )
    texts = docs.select(F.col("doc_id").alias("_id"), body.alias("_body"))
    repeated = (
        texts.groupBy(_digest(F.col("_body")).alias("_hash")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash")
    )
    groups = (
        texts.withColumn("_hash", _digest(F.col("_body")))
        .join(repeated, "_hash", "left_semi")
        .groupBy("_body")
        .agg(KEEP[keep]("_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
        .select(_digest(F.col("_body")).alias("_hash"), F.sha2(F.col("_body"), 256).alias("_sha"), "_keep", "_size")
    )
    alone = F.col("_size").isNull()
    keep_id = F.when(alone, F.col("_id")).otherwise(F.col("_keep"))
    return rows.join(groups, ["_hash", "_sha"], "left").select(
        F.col("_id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.coalesce(F.col("_size"), F.lit(1).cast("bigint")).alias("group_size"),
        keep_id.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
        *(F.col(f"_carry{i}") for i in range(len(carry))),
    )


def drop_copies(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` with one row left of each group of equal texts; columns as given.

    Ties as in ``copy_groups``; of rows that repeat both id and text one stays.
    """
    names = docs.columns
    marked = copy_groups(docs, keep, carry=names).where("kept")
    single = marked.where("group_size = 1")
    winners = marked.where("group_size > 1").dropDuplicates(["doc_id", "text_sha256"])
    return single.unionByName(winners).select(*(F.col(f"_carry{i}").alias(name) for i, name in enumerate(names)))


def exact_dedup_query(documents: DataFrame) -> DataFrame:
    return copy_groups(documents, keep="largest")


EXACT_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
