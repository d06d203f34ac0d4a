"""A ledger of batch jobs: extend, apply status events, report."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.functions import SERVER_SCOPE, scope_of

# Outcome codes; NULL is pending (fixed values).
SUCCEEDED = 0
FAILED = 1

# Status texts by outcome; the None entry is pending (fixed values).
STATUS_TEXTS = {FAILED: "Ошибка", SUCCEEDED: "Успешно", None: "Не обработано"}
ENGLISH_STATUS_TEXTS = {FAILED: "error", SUCCEEDED: "success", None: "pending"}


def extend_ledger(ledger: DataFrame, pending: DataFrame, created: datetime | None = None) -> DataFrame:
    """The ledger plus one unprocessed entry per pending row.

    ``pending`` carries ``dbName`` and any of the command columns; entries are stamped ``created``, or now.
    """
    stamp = F.lit(created) if created is not None else F.current_timestamp()
    types = dict(ledger.dtypes)
    new = pending.select(*[c for c in pending.columns if c in types])
    if "creation_dt" in types and "creation_dt" not in new.columns:
        new = new.withColumn("creation_dt", stamp.cast(types["creation_dt"]))
    return ledger.unionByName(new, allowMissingColumns=True)


def apply_events(ledger: DataFrame, events: DataFrame, strict_reference: bool = False) -> DataFrame:
    """The ledger after a set of status events.

    Events carry ``dbName``, ``event_dt``, ``event`` (``started``, ``succeeded`` or ``failed``) and
    ``error_msg``.  A start sets ``start_dt``; an outcome sets ``processed`` and ``finish_dt``; a failure
    also sets ``error_msg``, which a later success leaves as it is.  Of several events of a kind the
    latest counts; of an outcome pair at one instant the failure does.

    Events are reduced to one row per job with partial aggregation, so a job with very many events is no
    bottleneck.  ``strict_reference=True`` applies a failure to every entry, not only to its own job.
    """
    keys = [*scope_of(ledger, events, names=SERVER_SCOPE), "dbName"]

    def at(kind: str) -> Column:
        return F.max(F.when(F.col("event") == kind, F.col("event_dt")))

    # instants are of fixed width, so these maxima are kept in hash tables and nothing is sorted
    last = events.groupBy(*keys).agg(at("started").alias("_started"), at("succeeded").alias("_succeeded"), at("failed").alias("_failed"))
    failed = events.where("event = 'failed'").select(*keys, F.col("event_dt").alias("_failed"), F.col("error_msg").alias("_message"))
    if strict_reference:
        newest = failed.agg(F.max("_failed").alias("_newest"))
        messages = failed.join(F.broadcast(newest), F.col("_failed") == F.col("_newest")).agg(F.max(F.struct("_failed", "_message")).alias("_spread"))
        met = ledger.join(last, keys, "left").withColumn("_spread", messages.scalar())
        met = met.withColumns({"_message": F.col("_spread._message"), "_failed": F.greatest("_failed", "_spread._failed")})
    else:
        # the message of the last failure comes by its instant; several at one instant are few, the greatest counts
        shown = last.where("_failed IS NOT NULL").join(failed, [*keys, "_failed"])
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_message")))
        shown = shown.withColumn("_rank", rank).where("_rank = 1").select(*keys, "_message")
        met = ledger.join(last, keys, "left").join(shown, keys, "left")
    code = F.when(F.col("_failed") >= F.coalesce("_succeeded", "_failed"), F.lit(FAILED)).when(F.col("_succeeded").isNotNull(), F.lit(SUCCEEDED))
    message = F.when(F.col("_failed").isNotNull(), F.col("_message")).otherwise(F.col("error_msg"))
    types = dict(ledger.dtypes)
    changed = {
        "processed": F.coalesce(code, "processed").cast(types["processed"]),
        "start_dt": F.coalesce("_started", "start_dt"),
        "finish_dt": F.coalesce(F.greatest("_succeeded", "_failed"), "finish_dt"),
        "error_msg": message,
    }
    return met.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in ledger.columns])


def ledger_report(ledger: DataFrame, texts: Mapping[int | None, str] = STATUS_TEXTS) -> DataFrame:
    """Status of every entry in words, by start time."""
    status = F.lit(texts[None])
    for code in (SUCCEEDED, FAILED):
        status = F.when(F.col("processed") == code, F.lit(texts[code])).otherwise(status)
    scope = scope_of(ledger, names=SERVER_SCOPE)
    return ledger.orderBy("start_dt", *scope, "dbName").select(
        *scope, "dbName", status.alias("Status"), "start_dt", "finish_dt", "error_msg"
    )


def next_pending(ledger: DataFrame) -> DataFrame:
    """One entry that is still pending: the first by name."""
    return (
        ledger.where(F.col("processed").isNull())
        .orderBy(*scope_of(ledger, names=SERVER_SCOPE), "dbName")
        .limit(1)
        .select(*scope_of(ledger, names=SERVER_SCOPE), "dbName", "restore_command")
    )
