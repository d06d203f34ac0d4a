"""Row generation, sampling, keyed updates, deletes and top-k.  Each returns the new table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetvitals.functions import fixed_width
from fleetvitals.plans import durable, first_rows, number_any

# Rows of the generator, stages of a task, sample sizes and rounds (fixed values).
TASKS = 4096
STAGES = 10
SAMPLE = 150
ROUND_SAMPLE = 75
ROUNDS = 50
EXPIRY_SECONDS = 8192
TOP_ROWS = 1000


def _numbers(source: SparkSession | DataFrame, n: int | None) -> DataFrame:
    """``id`` from 1: ``n`` of them, or one for each row of a frame, numbered where the rows lie."""
    if isinstance(source, DataFrame):
        counted = number_any(source.select(F.lit(True).alias("_row")), "_at").select((F.col("_at") + 1).alias("id"))
        return counted if n is None else counted.where(F.col("id") <= n)
    return source.range(1, n + 1)


def generate_tasks(source: SparkSession | DataFrame, n: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """Task rows: numbered from 1, stage by number, defaults for key and time.

    From a session ``n`` of them (``TASKS``, if not given); from a frame as many as it has rows (``n`` at most).
    """
    if n is None and not isinstance(source, DataFrame):
        n = TASKS
    numbered = _numbers(source, n).select(F.col("id").alias("task_id"), (F.col("id") % STAGES).cast("int").alias("stage"))
    return with_defaults(numbered, as_of=as_of).select("uuid", "task_id", "stage", "valid_to")


def generate_sequence(source: SparkSession | DataFrame, n: int | None, start: datetime) -> DataFrame:
    """``n`` rows, or one per row of a frame, one second apart; the row number as key and as text."""
    number = F.col("id")
    return _numbers(source, n).select(
        number.alias("i"),
        F.timestamp_add("SECOND", number, F.lit(start)).alias("d"),
        number.cast("string").alias("v"),
    )


def with_defaults(
    df: DataFrame, key: str = "uuid", stamp: str = "valid_to", as_of: datetime | None = None
) -> DataFrame:
    """Fill an absent or NULL key with a new id, and an absent or NULL time with ``as_of`` or now."""
    now = F.lit(as_of) if as_of is not None else F.current_timestamp()
    now = F.date_trunc("SECOND", now)
    if stamp in df.columns:
        now = now.cast(dict(df.dtypes)[stamp])
    new_id = F.uuid()
    return df.withColumns(
        {
            key: F.coalesce(F.col(key), new_id) if key in df.columns else new_id,
            stamp: F.coalesce(F.col(stamp), now) if stamp in df.columns else now,
        }
    )


def _shuffled(key: str, seed: object) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def sample_exact(df: DataFrame, n: int = SAMPLE, key: str = "uuid", seed: object = 0) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer) in an order that depends on key and seed only.

    The same seed gives the same sample on any cluster; another seed gives an unrelated one.
    """
    numbered = df.withColumn("_order", _shuffled(key, seed))
    return first_rows(numbered, ["_order", key], n).drop("_order")


def update_where_in(df: DataFrame, keys: DataFrame, key: str, changes: Mapping[str, Column]) -> DataFrame:
    """The table with ``changes`` applied to rows whose key is in ``keys``."""
    marks = keys.select(key).distinct().withColumn("_hit", F.lit(True))
    met = df.join(marks, key, "left")
    hit = F.col("_hit").isNotNull()
    return met.select(
        *[F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in df.columns]
    )


def update_all(df: DataFrame, changes: Mapping[str, Column]) -> DataFrame:
    """The table with ``changes`` applied to every row."""
    return df.withColumns(dict(changes))


def add_seconds(column: str, seconds: str) -> Column:
    """A timestamp moved by a number of seconds held in another column."""
    return F.timestamp_add("SECOND", F.col(seconds), F.col(column))


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The table without the rows that meet the condition; rows where it is NULL stay."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_expired(
    df: DataFrame, column: str = "valid_to", ahead_seconds: int = EXPIRY_SECONDS, as_of: datetime | None = None
) -> DataFrame:
    """The table without rows dated ``ahead_seconds`` or more after ``as_of`` (or now)."""
    now = F.lit(as_of) if as_of is not None else F.current_timestamp()
    bound = F.timestamp_add("SECOND", F.lit(ahead_seconds), now)
    return delete_where(df, F.col(column) >= bound.cast(dict(df.dtypes)[column]))


def _drawn(keys: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` keys of every round.  Each task cuts its part to ``n`` per round before the shuffle."""
    rank = F.row_number().over(Window.partitionBy("_round").orderBy("_order", key))
    return keys.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def _low_keys(keys: DataFrame, key: str, rounds: int, n: int, share: int) -> DataFrame:
    """(key, ``_round``, ``_order``) of the keys that can be among the ``n`` lowest of a round.

    A row looks at its place in all rounds at once and leaves only those below a bound, so it isn't repeated for every
    round.  Orders are spread evenly, so a bound some deviations above n of all rows holds ``n`` keys of every round
    almost always; where a round has fewer, the bound is raised, until it holds all rows.  ``share`` divides the first bound.
    """
    rows = keys.count()
    bounded = (n + 8 * n**0.5 + 32) / max(rows, 1) / share

    def place(round_: Column) -> Column:
        return F.md5(F.concat(round_.cast("string"), F.lit(":"), F.col(key).cast("string")))

    everything = F.sequence(F.lit(1), F.lit(rounds))
    while True:
        low = everything
        if bounded < 1:
            bound = f"{int(bounded * 16**12):012x}"
            low = F.filter(everything, lambda round_: place(round_) < bound)
        found = durable(keys.select(key, F.explode(low).alias("_round")).withColumn("_order", place(F.col("_round"))))
        full = found.groupBy("_round").count().where(F.col("count") >= n)
        if bounded >= 1 or full.count() == rounds:
            return found
        bounded *= 4


def repeat_update(
    df: DataFrame,
    key: str = "uuid",
    column: str = "stage",
    rounds: int = ROUNDS,
    n: int = ROUND_SAMPLE,
    share: int = 1,
) -> DataFrame:
    """``rounds`` times: sample ``n`` keys, then add one to ``column`` for them.  One pass over the table.

    The samples do not depend on the updated column, so all rounds are drawn at once and a row gains the
    number of rounds that drew it.  A round draws its ``n`` lowest keys in that round's order; what can be among
    them is found without repeating the rows (``_low_keys``) and holds little more than ``n`` keys a round.  The result
    is the same with any ``share``, which makes the first bound narrower.
    """
    keys = df.select(key).where(F.col(key).isNotNull())
    hits = _drawn(_low_keys(keys, key, rounds, n, share), key, n).groupBy(key).agg(F.count(F.lit(1)).alias("_hits"))
    type_ = dict(df.dtypes)[column]
    met = df.join(hits, key, "left")
    gained = (F.col(column) + F.coalesce(F.col("_hits"), F.lit(0))).cast(type_)
    return met.select(*[gained.alias(c) if c == column else F.col(c) for c in df.columns])


def top_k(df: DataFrame, order: str | Sequence[str], k: int = TOP_ROWS) -> DataFrame:
    """The first ``k`` rows by the given columns, which should end in a unique one."""
    return first_rows(df, [order] if isinstance(order, str) else list(order), k)


def to_fixed_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """The table with a column as blank-padded text of fixed width."""
    return df.withColumn(column, fixed_width(F.col(column), width))
