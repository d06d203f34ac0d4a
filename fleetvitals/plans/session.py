"""Session settings the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# The per-task cut of a ranking applies up to this many rows per group.
GROUP_LIMIT = {"spark.sql.optimizer.windowGroupLimitThreshold": "20000"}

# Joins of a large fact table with a key-unique side are left to adaptive execution: it broadcasts a side
# whose measured size is small and splits a hot key of the fact side over many tasks.  Forcing allows
# that split even where the join's partitioning would otherwise be reused by a later grouping.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # hash instead of sort-merge once all partitions of a side have turned out this small
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}

# Shuffle files go as soon as their query has run, so a chain of checkpoints needs disk for one step at a time.
# Lost files are made again while the query runs, as always.
CLEANUP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

# Rows that a Python worker gets at a time.  Texts are a few KB long, so a batch stays at some MB in both processes; rows
# that hold arrays may be much longer, so bytes have a bound too.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4MB"}


# Whether a join on several columns shuffles a side that is partitioned by some of them already.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def tune(spark: SparkSession, subset_joins: bool = False) -> SparkSession:
    """Switch on adaptive execution with skew splitting, group limits, clean-up of shuffles and small batches; other settings stay as they are.

    ``subset_joins=True`` lets joins on several columns take rows as they are partitioned by some of them, which
    saves shuffles of wide fact rows (locks by database and entity after a join by entity).
    """
    for key, value in {**ADAPTIVE, **GROUP_LIMIT, **CLEANUP, **ARROW, ALL_KEYS: str(not subset_joins).lower()}.items():
        spark.conf.set(key, value)
    return spark
