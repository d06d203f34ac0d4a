"""Gapless numbers for the rows of a very large table, without sorting it in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.plans.durable import durable, stored


def _offsets(counts: DataFrame, dealt: str, within: Sequence[str], total: str) -> DataFrame:
    """Rows of a group before each part, and in all, from one count per part and group."""
    if within:
        group = Window.partitionBy(*within).orderBy(dealt)
        before = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, -1))
        whole = F.sum("_n").over(group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return counts.select(dealt, *within, F.coalesce(before, F.lit(0)).alias("_before"), whole.alias(total))
    # without groups there is one count per task, so as many numbers as Spark itself keeps for a stage
    parts = sorted((row[dealt], row["_n"]) for row in counts.collect())
    ends = list(accumulate(n for _, n in parts))
    rows = [(part, end - n, ends[-1]) for (part, n), end in zip(parts, ends, strict=True)]
    kind = dict(counts.dtypes)[dealt]
    return F.broadcast(counts.sparkSession.createDataFrame(rows, f"{dealt} {kind}, _before bigint, `{total}` bigint"))


def _prefix_sums(rows: DataFrame, dealt: str, within: Sequence[str], name: str, total: str) -> DataFrame:
    """Rows with ``_local``, their number in (part, group), turned into ``name``, their number in the group."""
    counts = rows.groupBy(dealt, *within).agg(F.count(F.lit(1)).alias("_n"))
    keys = [dealt, *within]
    offsets = _offsets(counts, dealt, within, total).withColumnsRenamed({c: f"_of_{i}" for i, c in enumerate(keys)})
    same = [F.col(c).eqNullSafe(F.col(f"_of_{i}")) for i, c in enumerate(keys)]
    met = rows.join(offsets, reduce(lambda a, b: a & b, same))
    return met.withColumn(name, F.col("_before") + F.col("_local")).drop("_before", "_local", dealt, *(f"_of_{i}" for i in range(len(keys))))


def number_rows(
    rows: DataFrame,
    order: Sequence[Column | str],
    within: Sequence[str] = (),
    name: str = "position",
    total: str = "group_rows",
) -> DataFrame:
    """The rows with ``name``, their number (from 0, no gaps) by ``order`` in their group, and ``total``, its size.

    Rows are dealt into ranges of (``within``, ``order``) and checkpointed, so the range a row is in can't change
    when a task runs again.  A row's number is its number in the range plus the rows of its group in earlier
    ranges, which come from one count per range and group.  A group, or a tie, of any size spreads over
    ranges, because the place of a row in the input breaks ties; of rows equal in ``order`` any may be first.
    A null in ``within`` is a group of its own.  No rows give no rows.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = durable(tied.repartitionByRange(*within, *order, "_tie").withColumn("_part", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order, "_tie")).cast("bigint") - 1
    placed = dealt.withColumn("_local", local)
    return _prefix_sums(placed, "_part", within, name, total).drop("_tie")


def number_any(rows: DataFrame, name: str = "position") -> DataFrame:
    """The rows with ``name``, a number from 0 without gaps, in no particular order and without moving them.

    The lower bits of ``monotonically_increasing_id`` count the rows of a task, the upper ones name the task; the rows
    are stored with it, and one count per task gives the offsets.
    """
    marked = stored(rows.withColumn("_mark", F.monotonically_increasing_id()))
    parts = marked.withColumns({"_part": F.shiftright("_mark", 33), "_local": F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1))})
    return _prefix_sums(parts.drop("_mark"), "_part", (), name, "_rows").drop("_rows")


def repeat_rows(rows: DataFrame, times: Column, name: str = "copy") -> DataFrame:
    """Each row as often as ``times`` says (null or below 1: not at all), numbered from 0 in ``name``.

    The numbers are generated row by row inside the tasks; nothing passes the driver.
    """
    count = F.coalesce(times, F.lit(0)).cast("bigint")
    wanted = rows.withColumn("_times", count).where("_times > 0")
    return wanted.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_times") - 1))).drop("_times")
