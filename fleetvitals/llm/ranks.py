"""Exact row positions in an order, without sorting the table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(rows: DataFrame, within: Sequence[str], bucket: str, order: Sequence[Column | str]) -> DataFrame:
    """Rows with ``_position`` (from 0) in their group and ``_rows``, the size of the group.

    ``bucket`` is a whole number that rises with ``order``, with a fixed number of values.  Rows are ranked
    inside (group, bucket), where a task sees one bucket only; counts per bucket, at most as many rows as
    buckets and groups, give the offsets.  ``within`` columns and ``bucket`` must not be null.
    """
    keys = [*within, bucket]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*within) if within else Window.partitionBy()
    before = group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        F.sum("_n").over(group).alias("_rows"),
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint") - 1
    return rows.withColumn("_local", local).join(offsets, keys).withColumn("_position", F.col("_before") + F.col("_local")).drop("_before", "_local")
