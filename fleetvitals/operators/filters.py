"""Row selection shared by the reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetvitals.functions import CATALOG_SCOPE, scope_of

# Databases with an id up to this one belong to the server itself (fixed value).
LAST_SYSTEM_DATABASE = 4

# Wait types that say nothing about load (fixed values).
IGNORED_WAITS = (
    "BROKER_EVENTHANDLER",
    "BROKER_RECEIVE_WAITFOR",
    "BROKER_TASK_STOP",
    "BROKER_TO_FLUSH",
    "BROKER_TRANSMITTER",
    "CHECKPOINT_QUEUE",
    "CHKPT",
    "CLR_AUTO_EVENT",
    "CLR_MANUAL_EVENT",
    "CLR_SEMAPHORE",
    "CXCONSUMER",
    "DBMIRROR_DBM_EVENT",
    "DBMIRROR_EVENTS_QUEUE",
    "DBMIRROR_WORKER_QUEUE",
    "DBMIRRORING_CMD",
    "DIRTY_PAGE_POLL",
    "DISPATCHER_QUEUE_SEMAPHORE",
    "EXECSYNC",
    "FSAGENT",
    "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "FT_IFTSHC_MUTEX",
    "HADR_CLUSAPI_CALL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "HADR_LOGCAPTURE_WAIT",
    "HADR_NOTIFICATION_DEQUEUE",
    "HADR_TIMER_TASK",
    "HADR_WORK_QUEUE",
    "KSOURCE_WAKEUP",
    "LAZYWRITER_SLEEP",
    "LOGMGR_QUEUE",
    "MEMORY_ALLOCATION_EXT",
    "ONDEMAND_TASK_QUEUE",
    "PARALLEL_REDO_DRAIN_WORKER",
    "PARALLEL_REDO_LOG_CACHE",
    "PARALLEL_REDO_TRAN_LIST",
    "PARALLEL_REDO_WORKER_SYNC",
    "PARALLEL_REDO_WORKER_WAIT_WORK",
    "PREEMPTIVE_OS_FLUSHFILEBUFFERS",
    "PREEMPTIVE_XE_GETTARGETSTATE",
    "PWAIT_ALL_COMPONENTS_INITIALIZED",
    "PWAIT_DIRECTLOGCONSUMER_GETNEXT",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_ASYNC_QUEUE",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP",
    "QDS_SHUTDOWN_QUEUE",
    "REDO_THREAD_PENDING_WORK",
    "REQUEST_FOR_DEADLOCK_SEARCH",
    "RESOURCE_QUEUE",
    "SERVER_IDLE_CHECK",
    "SLEEP_BPOOL_FLUSH",
    "SLEEP_DBSTARTUP",
    "SLEEP_DCOMSTARTUP",
    "SLEEP_MASTERDBREADY",
    "SLEEP_MASTERMDREADY",
    "SLEEP_MASTERUPGRADED",
    "SLEEP_MSDBSTARTUP",
    "SLEEP_SYSTEMTASK",
    "SLEEP_TASK",
    "SLEEP_TEMPDBSTARTUP",
    "SNI_HTTP_ACCEPT",
    "SOS_WORK_DISPATCHER",
    "SP_SERVER_DIAGNOSTICS_SLEEP",
    "SQLTRACE_BUFFER_FLUSH",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "SQLTRACE_WAIT_ENTRIES",
    "VDI_CLIENT_OTHER",
    "WAIT_FOR_RESULTS",
    "WAITFOR",
    "WAITFOR_TASKSHUTDOWN",
    "WAIT_XTP_RECOVERY",
    "WAIT_XTP_HOST_WAIT",
    "WAIT_XTP_OFFLINE_CKPT_NEW_LOG",
    "WAIT_XTP_CKPT_CLOSE",
    "XE_DISPATCHER_JOIN",
    "XE_DISPATCHER_WAIT",
    "XE_TIMER_EVENT",
)


def active_waits(waits: DataFrame, ignore: Iterable[str] | DataFrame = IGNORED_WAITS) -> DataFrame:
    """Wait counters that were hit at least once and are not on the ignore list.

    The list is a set of names, or a frame with a ``wait_type`` column for lists kept as data.  Rows
    without a wait type are dropped, as ``NOT IN`` does.
    """
    hit = waits.where(F.col("wait_type").isNotNull() & (F.col("waiting_tasks_count") > 0))
    if isinstance(ignore, DataFrame):
        return hit.join(ignore.select("wait_type"), "wait_type", "left_anti")
    names = list(ignore)
    return hit.where(~F.col("wait_type").isin(names)) if names else hit


def optional_filter(df: DataFrame, **equals: object) -> DataFrame:
    """Equality filters; a ``None`` value means no filter on that column."""
    for name, value in equals.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def parse_names(csv: str) -> list[str]:
    """Names of a comma-separated list, all spaces removed (so a name with a space never matches)."""
    return [name for name in csv.replace(" ", "").split(",") if name]


def select_names(
    databases: DataFrame, csv: str = "all", last_system_database: int = LAST_SYSTEM_DATABASE
) -> DataFrame:
    """Databases named in a comma-separated list, or every user database for ``'all'``.

    Names on the list may be system databases too.
    """
    if csv == "all":
        return databases.where(F.col("database_id") > last_system_database)
    return databases.where(F.col("name").isin(parse_names(csv)))


def pending_work(
    catalog: DataFrame,
    ledger: DataFrame,
    exclude: Iterable[str] = (),
    last_system_database: int = LAST_SYSTEM_DATABASE,
) -> DataFrame:
    """Online user databases that the ledger does not list yet and that are not excluded."""
    online = catalog.where(
        (F.col("database_id") > last_system_database)
        & (F.col("state_desc") == "ONLINE")
        & F.col("name").isNotNull()
    )
    excluded = list(exclude)
    if excluded:
        online = online.where(~F.col("name").isin(excluded))
    scope = scope_of(catalog, ledger, names=("server_id",))
    listed = ledger.select(*scope, F.col("dbName").alias("name"))
    return online.join(listed, [*scope, "name"], "left_anti").select(*catalog.columns)


def placement_drift(
    indexes: DataFrame, filegroups: DataFrame, target: str, object_id: int | None = None
) -> DataFrame:
    """Tables (heap or clustered index) that lie in another storage group than the target."""
    scope = scope_of(indexes, filegroups, names=CATALOG_SCOPE)
    base = optional_filter(indexes, object_id=object_id).where(F.col("index_id").isin(0, 1))
    groups = filegroups.where(F.col("name") != target).select(
        *scope, "data_space_id", F.col("name").alias("filegroup_name")
    )
    kept = scope_of(indexes, indexes, names=CATALOG_SCOPE)
    return base.join(groups, [*scope, "data_space_id"]).select(
        *kept, "object_id", "index_id", F.col("name").alias("index_name"), "is_unique", "filegroup_name"
    )


def secondary_indexes(
    indexes: DataFrame, object_id: int | None = None, enabled_only: bool = True
) -> DataFrame:
    """Indexes other than the table itself; by default only those that are enabled."""
    found = optional_filter(indexes, object_id=object_id).where(F.col("index_id") > 1)
    return found.where(~F.col("is_disabled")) if enabled_only else found


def require_exists(df: DataFrame, condition: Column, message: str) -> None:
    """Raise ``ValueError`` with the message when no row meets the condition."""
    if df.where(condition).isEmpty():
        raise ValueError(message)
