"""Tagged snapshots: capture, append, store, reuse, release."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetvitals.plans import durable

# Tags of the first and the second sample (fixed values).
BEFORE = 1
AFTER = 10


def capture(df: DataFrame, snapshot_id: int = BEFORE, captured_at: datetime | None = None) -> DataFrame:
    """Tag the rows of a relation as one snapshot."""
    tagged = df.withColumn("snapshot_id", F.lit(snapshot_id))
    if captured_at is not None:
        tagged = tagged.withColumn("captured_at", F.lit(captured_at))
    return tagged


def append_snapshot(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both snapshots in one frame; columns are matched by name."""
    return first.unionByName(second)


def write_snapshot(df: DataFrame, path: str, mode: str = "replace") -> None:
    """Store a tagged snapshot; one folder per tag, so a later read of one tag skips the others.

    ``'replace'`` overwrites the folders of the tags that the frame holds and leaves the others, so a snapshot that
    is written again counts once.  Other modes are Spark's own; ``'append'`` adds rows to a tag.
    """
    writer = df.write.partitionBy("snapshot_id")
    if mode == "replace":
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode(mode).parquet(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = True
) -> DataFrame:
    """The stored snapshot at ``path``, or a new one when asked for, absent or empty."""
    if not refresh:
        try:
            stored = spark.read.parquet(path)
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
        else:
            if not stored.isEmpty():
                return stored
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def release(df: DataFrame) -> None:
    """Let go of the cached blocks of a snapshot.  Stored files are never deleted."""
    df.unpersist()


def fan_out(df: DataFrame, targets: Mapping[str, Sequence[str] | None]) -> None:
    """Write the rows to several paths, each with its own column list (``None`` keeps all).

    The source is evaluated once, into a reliable checkpoint, so that all targets get the same rows even if
    an executor is lost between the writes and the source has generated ids.
    """
    kept = durable(df)
    for path, columns in targets.items():
        (kept.select(*columns) if columns else kept).write.mode("append").parquet(path)
