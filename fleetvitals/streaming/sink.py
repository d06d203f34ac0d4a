"""Counter deltas of a stream, micro-batch by micro-batch, from a stored last capture per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from fleetvitals.operators.counters import counter_deltas


def _latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of every key.  Tasks cut their part to one row per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


class DeltaBatches:
    """The step taken for every micro-batch; see ``delta_sink``."""

    def __init__(self, keys, counters, folder, time, delay, expiry, mode):
        self.keys, self.counters, self.time, self.mode = list(keys), list(counters), time, mode
        self.folder, self.delay, self.expiry = folder.rstrip("/"), delay, expiry
        self.columns = [*self.keys, time, *self.counters]

    def _state(self, number: int) -> str:
        # the state before a batch stays until the batch after it, so a batch that runs again finds what it found
        return f"{self.folder}/state/{number % 2}"

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, F.col(self.time)
        rows = batch.select(*self.columns).persist()
        try:
            if number:
                state = spark.read.parquet(self._state(number - 1))
            else:
                state = spark.createDataFrame([], rows.schema).withColumn("_kind", F.lit(""))
            marks = rows.agg(F.max(at - F.expr(f"INTERVAL {self.delay}")).alias("m")).union(
                state.where("_kind = 'mark'").agg(F.max(at).alias("m"))
            )
            reached, seen = marks.agg(F.max("m"), F.lit(0)).first()[0], state.where("_kind = 'mark'").agg(F.max(at)).first()[0]
            kind = dict(rows.dtypes)[self.time]
            before, now = (F.lit(m).cast(kind) for m in (seen, reached))
            placed = at.isNotNull() & (F.lit(True) if seen is None else at > before)
            rows.where(~F.coalesce(placed, F.lit(False))).write.mode("overwrite").parquet(f"{self.folder}/late/batch={number}")
            timely = rows.where(placed).unionByName(state.where("_kind = 'waiting'").select(*self.columns))
            ready = timely.where(at <= now)
            history = state.where("_kind = 'last'").select(*self.columns).unionByName(ready)
            deltas = counter_deltas(history, self.keys, self.counters, self.time, self.mode)
            deltas.write.mode("overwrite").parquet(f"{self.folder}/deltas/batch={number}")
            last = _latest(history, self.keys, [self.time, *self.counters])
            if self.expiry is not None:
                last = last.where(at >= now - F.expr(f"INTERVAL {self.expiry}"))
            nothing = [F.lit(None).cast(t).alias(c) for c, t in rows.select(*self.keys).dtypes]
            blank = [F.lit(None).cast(t).alias(c) for c, t in rows.select(*self.counters).dtypes]
            mark = spark.range(1).select(*nothing, now.alias(self.time), *blank, F.lit("mark").alias("_kind"))
            kept = last.withColumn("_kind", F.lit("last")).unionByName(timely.where(at > now).withColumn("_kind", F.lit("waiting")))
            kept.unionByName(mark).write.mode("overwrite").parquet(self._state(number))
        finally:
            rows.unpersist()


def delta_sink(
    stream: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    folder: str,
    time: str = "captured_at",
    delay: str = "10 minutes",
    expiry: str | None = "7 days",
    mode: str = "signed",
) -> DataStreamWriter:
    """A stream writer that puts the deltas of a stream of captures into ``folder``/deltas.

    Each micro-batch is joined with what the batches before have left, by the operators of ``counter_deltas`` alone:
    NULL counters give NULL deltas, ties and modes are as there, and no row is handled by Python.  Captures wait
    until ``delay`` behind the newest capture seen has passed them, and are then compared in order of time.

    The state is one table: the last compared capture of every key, the captures that wait, and the instant
    reached.  It is replaced with every batch, and a key without a capture for ``expiry`` (None: never) leaves it, so it
    has a row per live key and a delay's worth of captures; its next capture is a first one again.  Captures
    of all keys come with each sample of a server, so replacing the state costs no more than reading a batch.

    A capture without a time, or not after the instant reached, can't be placed any more; such rows are kept in
    ``folder``/late.  Results are written per batch and overwritten when a batch runs again, and the state before it
    stays until the next batch, so each batch counts once.  Start the writer with a ``checkpointLocation``; a new
    one needs a new folder.
    """
    return stream.writeStream.foreachBatch(DeltaBatches(keys, counters, folder, time, delay, expiry, mode))
