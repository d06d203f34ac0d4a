"""Differences of cumulative counters between snapshots."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.functions import SERVER_SCOPE, guarded, half_up, scope_of
from fleetvitals.operators.filters import IGNORED_WAITS, active_waits

WAIT_COUNTERS = {
    "wait_time_ms": "wait_time_ms",
    "signal_wait_time_ms": "signal_wait_time_ms",
    "waiting_tasks_count": "wait_count",
}

FILE_COUNTERS = (
    "num_of_reads",
    "num_of_bytes_read",
    "io_stall_read_ms",
    "num_of_writes",
    "num_of_bytes_written",
    "io_stall_write_ms",
    "io_stall",
)

RESETS = ("reference", "null")


def latest_capture(side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of each key's latest capture.  Counters are cumulative, so earlier captures of a side say nothing more.

    Without ``captured_at`` a side is one capture, as are the rows of a key that has no time at all.
    """
    if "captured_at" not in side.columns:
        return side
    last = side.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max("captured_at").alias("_at"))
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return side.join(last, [*match, F.col("captured_at").eqNullSafe(F.col("_at"))]).select(*side.columns)


def wait_delta(before: DataFrame, after: DataFrame, reset: str = "reference") -> DataFrame:
    """Absolute change of each wait counter between two snapshots; a missing side counts as zero.

    A wait type occurs once per snapshot, so the full outer join of the two is the same as grouping their
    union by wait type.  The grouping needs one shuffle of partial sums and no sort.

    ``reset='reference'`` reports a counter that went back (a restart) by its absolute change.
    ``reset='null'`` reports all three changes of such a wait type as NULL instead.
    """
    if reset not in RESETS:
        raise ValueError(f"reset must be one of {RESETS}")
    keys = [*scope_of(before, after, names=SERVER_SCOPE), "wait_type"]
    before, after = latest_capture(before, keys), latest_capture(after, keys)
    sides = [
        side.select(*keys, *[(F.coalesce(F.col(c), F.lit(0)) * sign).alias(n) for c, n in WAIT_COUNTERS.items()])
        for side, sign in ((before, -1), (after, 1))
    ]
    change = sides[0].unionByName(sides[1]).where(F.col("wait_type").isNotNull())
    names = list(WAIT_COUNTERS.values())
    change = change.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in names])
    if reset == "null":
        back = F.least(*[F.col(n) for n in names]) < 0
        held = change.where(back | (F.col("wait_count") > 0))
        return held.select(*keys, *[F.when(~back, F.col(n)).alias(n) for n in names])
    return change.where(F.col("wait_count") != 0).select(*keys, *[F.abs(n).alias(n) for n in names])


def wait_report(delta: DataFrame, order: str = "wait_time") -> DataFrame:
    """Readable wait report, most waited first."""
    keys = [*scope_of(delta, names=SERVER_SCOPE), "wait_type"]
    total, signal, count = (F.col(n) for n in WAIT_COUNTERS.values())
    report = delta.select(
        *keys,
        "wait_count",
        half_up(total, count, 2).alias("avg_wait_time_ms"),
        half_up(total, 1000, 4).alias("wait_time_S"),
        half_up(total - signal, 1000, 4).alias("resource_wait_time_S"),
        half_up(signal, 1000, 4).alias("signal_wait_time_S"),
        _exact_order(order, total, count).alias("_rank"),
    )
    return report.orderBy(F.desc("_rank"), *keys).drop("_rank")


def _exact_order(order: str, total: Column, count: Column) -> Column:
    if order == "avg_wait":
        return total.cast("decimal(20,0)") / guarded(count).cast("decimal(20,0)")
    return total if order == "wait_time" else count


def io_snapshot(databases: DataFrame, master_files: DataFrame, file_stats: DataFrame) -> DataFrame:
    """One row per database file with its counters; a file without counters keeps NULLs."""
    base_scope = scope_of(databases, master_files)
    stat_scope = scope_of(master_files, file_stats)
    names = databases.select(*base_scope, "database_id", F.col("name").alias("database_name"))
    files = master_files.select(*scope_of(master_files), "database_id", "file_id", "type_desc")
    return (
        files.join(names, [*base_scope, "database_id"])
        .join(
            file_stats.select(*stat_scope, "database_id", "file_id", "size_on_disk_bytes", *FILE_COUNTERS),
            [*stat_scope, "database_id", "file_id"],
            "left",
        )
        .select(
            *scope_of(master_files),
            F.col("database_name").alias("name"),
            "file_id",
            "type_desc",
            half_up(F.col("size_on_disk_bytes"), 1024 * 1024, 2).alias("file_size_mb"),
            *FILE_COUNTERS,
        )
    )


def io_delta(before: DataFrame, after: DataFrame, null_zero_stall: bool = False) -> DataFrame:
    """Signed change of the file counters, for files in both snapshots.

    ``null_zero_stall`` picks what a read or write latency shows when nothing stalled: 0 by default, NULL
    when set.  ``avg_latency_ms`` is operations per stalled millisecond; ``stall_ms_per_op`` is the inverse.
    """
    keys = [*scope_of(before, after, names=SERVER_SCOPE), "name", "file_id"]
    before, after = latest_capture(before, keys), latest_capture(after, keys)
    earlier = before.select(*keys, *[F.col(c).alias(f"was_{c}") for c in FILE_COUNTERS])
    both = after.join(earlier, keys)
    both = both.select(
        *keys, "type_desc", "file_size_mb", *[(F.col(c) - F.col(f"was_{c}")).alias(c) for c in FILE_COUNTERS]
    )
    reads, bytes_read, read_stall, writes, bytes_written, write_stall, stall = (
        F.col(c) for c in FILE_COUNTERS
    )

    def latency(stalled: Column, operations: Column) -> Column:
        return half_up(guarded(stalled) if null_zero_stall else stalled, operations, 3)

    return both.select(
        *keys,
        "type_desc",
        "file_size_mb",
        reads.alias("reads"),
        half_up(bytes_read, 1024, 2).alias("kbytes_read"),
        half_up(bytes_read, reads * 1024, 2).alias("kb_per_read"),
        latency(read_stall, reads).alias("read_latency_ms"),
        writes.alias("writes"),
        half_up(bytes_written, 1024, 2).alias("kbytes_written"),
        half_up(bytes_written, writes * 1024, 2).alias("kb_per_write"),
        latency(write_stall, writes).alias("write_latency_ms"),
        half_up(reads + writes, stall, 3).alias("avg_latency_ms"),
        half_up(stall, reads + writes, 3).alias("stall_ms_per_op"),
    )


def health_report(
    before: Mapping[str, DataFrame],
    after: Mapping[str, DataFrame],
    order: str = "wait_time",
    ignore: Sequence[str] | DataFrame = IGNORED_WAITS,
) -> dict[str, DataFrame]:
    """Waits and file activity between two captures.

    Each capture maps ``wait_stats``, ``databases``, ``master_files`` and ``file_stats`` to their frames.
    """
    waits = [active_waits(side["wait_stats"], ignore) for side in (before, after)]
    files = [io_snapshot(side["databases"], side["master_files"], side["file_stats"]) for side in (before, after)]
    return {"waits": wait_report(wait_delta(*waits), order), "files": io_delta(*files)}


def counter_deltas(
    history: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    time: str = "captured_at",
    mode: str = "signed",
    bucket_seconds: int = 86_400,
) -> DataFrame:
    """Change of each counter from one capture of a key to its next, over a whole history.

    The first capture of a key gives no row.  ``mode``: ``'signed'``, ``'abs'``, or ``'null'`` (a counter
    that went back gives NULL).

    A key's history can be long, so it is never ordered as a whole.  Captures are compared inside time
    buckets; the first capture of a bucket takes its predecessor from the last capture of the key's
    preceding bucket, and that step sees one row per bucket only.
    """
    if mode not in ("signed", "abs", "null"):
        raise ValueError("mode must be signed, abs or null")
    keys, counters = list(keys), list(counters)
    state = F.struct(F.col(time).alias("at"), *[F.col(c).alias(c) for c in counters])
    instant = F.col(time).cast("timestamp")
    rows = history.select(*keys, time, *counters).withColumn(
        "_bucket", F.floor(F.unix_seconds(instant) / F.lit(bucket_seconds)).cast("bigint")
    )
    # a row without a time has no place in the history; a null key is a key
    rows = rows.where(F.col("_bucket").isNotNull())
    in_bucket = Window.partitionBy(*keys, "_bucket").orderBy(time, *counters)
    inner = rows.withColumn("_was", F.lag(state).over(in_bucket))
    # the last capture of a bucket is the one that nothing follows; no payload goes through an aggregate
    last = rows.withColumn("_next", F.lead(time).over(in_bucket)).where("_next IS NULL").select(*keys, "_bucket", state.alias("_last"))
    carried = last.select(
        *[F.col(c).alias(f"_of_{c}") for c in [*keys, "_bucket"]], F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry")
    )
    paired = (
        inner.join(carried, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in [*keys, "_bucket"]], "left")
        .withColumn("_was", F.coalesce("_was", "_carry"))
        .where(F.col("_was").isNotNull())
    )

    def change(name: str) -> Column:
        step = F.col(name) - F.col(f"_was.{name}")
        if mode == "abs":
            step = F.abs(step)
        elif mode == "null":
            step = F.when(step >= 0, step)
        return step.alias(f"{name}_delta")

    return paired.select(*keys, F.col("_was.at").alias("from_time"), time, *[change(c) for c in counters])
