"""The registered queries: one per operator, each over the whole derived telemetry."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce, wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fleetvitals as fv
from checks.inputs import Telemetry
from fleetvitals.functions import format_datetime
from fleetvitals.plans import scratch_path

Query = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, Query] = {}

AS_OF = datetime(2000, 1, 1)
BACKUP_SHARE = "\\\\vault\\nightly\\"
BACKUP_FOLDER = "F:\\restore\\"
DATA_FOLDER = "G:\\files\\"


def query(name: str):
    def register(build: Callable[[Telemetry], DataFrame]) -> Callable[[Telemetry], DataFrame]:
        @wraps(build)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Telemetry(fv.tune(spark, subset_joins=True), sf_dir))

        REGISTRY[name] = run
        return build

    return register


# ---------------------------------------------------------------------------------------------- counters


def _delta(t: Telemetry) -> DataFrame:
    return fv.wait_delta(fv.active_waits(t.waits_before, t.ignored), fv.active_waits(t.waits_after, t.ignored))


@query("active_waits")
def active_waits(t):
    return fv.active_waits(t.waits_after, t.ignored)


@query("tagged_snapshots")
def tagged_snapshots(t):
    first, second = fv.capture(t.waits_before, fv.BEFORE), fv.capture(t.waits_after, fv.AFTER)
    return fv.append_snapshot(first, second)


@query("stored_snapshot")
def stored_snapshot(t):
    path = scratch_path(t.spark, "waits")
    fv.write_snapshot(fv.capture(t.waits_before, fv.BEFORE), path)
    fv.write_snapshot(fv.capture(t.waits_after, fv.AFTER), path)
    return fv.read_relation(t.spark, path, "wait_stats").where(F.col("snapshot_id") == fv.AFTER)


@query("reused_snapshot")
def reused_snapshot(t):
    def not_needed():
        raise AssertionError("the stored snapshot is there")

    path = scratch_path(t.spark, "databases")
    fv.load_or_build(t.spark, path, lambda: t.work_catalog)
    return fv.load_or_build(t.spark, path, not_needed, refresh=False)


@query("fan_out")
def fan_out(t):
    first, second = scratch_path(t.spark, "tasks"), scratch_path(t.spark, "stages")
    fv.fan_out(t.tasks, {first: None, second: ["uuid", "stage"]})
    copies = t.spark.read.parquet(first).withColumnRenamed("stage", "first_stage")
    return copies.join(t.spark.read.parquet(second), "uuid")


@query("wait_delta")
def wait_delta(t):
    return _delta(t)


@query("wait_report_wait_time")
def wait_report_wait_time(t):
    return fv.wait_report(_delta(t), "wait_time")


@query("wait_report_avg_wait")
def wait_report_avg_wait(t):
    return fv.wait_report(_delta(t), "avg_wait")


@query("wait_report_wait_count")
def wait_report_wait_count(t):
    return fv.wait_report(_delta(t), "wait_count")


@query("io_snapshot")
def io_snapshot(t):
    return fv.io_snapshot(t.databases, t.master_files, t.file_stats_after)


def _io_delta(t: Telemetry, null_zero_stall: bool) -> DataFrame:
    before = fv.io_snapshot(t.databases, t.master_files, t.file_stats_before)
    after = fv.io_snapshot(t.databases, t.master_files, t.file_stats_after)
    return fv.io_delta(before, after, null_zero_stall)


@query("io_delta")
def io_delta(t):
    return _io_delta(t, False)


@query("io_delta_null_stall")
def io_delta_null_stall(t):
    return _io_delta(t, True)


def _health(t: Telemetry) -> dict[str, DataFrame]:
    shared = {"databases": t.databases, "master_files": t.master_files}
    return fv.health_report(
        {**shared, "wait_stats": t.waits_before, "file_stats": t.file_stats_before},
        {**shared, "wait_stats": t.waits_after, "file_stats": t.file_stats_after},
        ignore=t.ignored,
    )


@query("health_report_waits")
def health_report_waits(t):
    return _health(t)["waits"]


@query("health_report_files")
def health_report_files(t):
    return _health(t)["files"]


@query("counter_history_delta")
def counter_history_delta(t):
    return fv.counter_deltas(t.wait_history, ["wait_type"], ["wait_time_ms", "waiting_tasks_count"])


@query("counter_history_delta_abs")
def counter_history_delta_abs(t):
    return fv.counter_deltas(t.wait_history, ["wait_type"], ["wait_time_ms", "waiting_tasks_count"], mode="abs")


@query("counter_history_delta_null")
def counter_history_delta_null(t):
    """A counter that went back gives NULL."""
    return fv.counter_deltas(t.wait_history, ["wait_type"], ["wait_time_ms", "waiting_tasks_count"], mode="null", bucket_seconds=3600 * 6)


@query("wait_delta_reset_null")
def wait_delta_reset_null(t):
    """The captures the other way round, as after a restart: changes that went back are unknown."""
    return fv.wait_delta(fv.active_waits(t.waits_after, t.ignored), fv.active_waits(t.waits_before, t.ignored), reset="null")


@query("delta_stream")
def delta_stream(t):
    """Runs the stream over all there is, into a table in the work folder, and reads the table."""
    schema = t.table("events").schema
    stream = t.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(t.folder)
    captures = stream.select(
        F.concat("event_type", F.lit("#"), F.col("user_id").cast("string")).alias("wait_type"),
        F.date_trunc("SECOND", F.col("ts").cast("timestamp")).alias("captured_at"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("wait_time_ms"),
    )
    deltas = fv.delta_stream(captures, ["wait_type"], ["wait_time_ms"], delay="0 seconds")
    target = scratch_path(t.spark, "deltas")
    (
        deltas.writeStream.format("parquet")
        .option("path", target)
        .option("checkpointLocation", scratch_path(t.spark, "deltas-progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return t.spark.read.parquet(target).select(
        "wait_type",
        F.col("from_time").cast("timestamp_ntz").alias("from_time"),
        F.col("captured_at").cast("timestamp_ntz").alias("captured_at"),
        "wait_time_ms_delta",
    )


def _arrivals(t: Telemetry) -> DataFrame:
    """Captures of single events as a stream of two micro-batches: views arrive after all others."""
    landed = scratch_path(t.spark, "arrivals")
    events = t.table("events").select(
        F.concat(F.lit("user#"), F.col("user_id").cast("string")).alias("wait_type"),
        F.col("ts").alias("captured_at"),
        # a counter that was not read
        F.when(F.col("value") >= 20, F.floor(F.col("value") * 1000).cast("bigint")).alias("wait_time_ms"),
        (F.col("event_type") == "view").alias("late"),
    )
    for late in (False, True):
        events.where(F.col("late") == late).drop("late").coalesce(1).write.mode("append").parquet(landed)
    schema = t.spark.read.parquet(landed).schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(landed)


def _sunk(t: Telemetry, delay: str) -> str:
    target = scratch_path(t.spark, "sink")
    writer = fv.delta_sink(_arrivals(t), ["wait_type"], ["wait_time_ms"], target, delay=delay, expiry=None)
    writer.option("checkpointLocation", scratch_path(t.spark, "sink-progress")).trigger(availableNow=True).start().awaitTermination()
    return target


@query("delta_sink")
def delta_sink(t):
    """Captures of the last days still wait when the stream ends."""
    return t.spark.read.parquet(f"{_sunk(t, '10 days')}/deltas").drop("batch")


@query("delta_sink_undelayed")
def delta_sink_undelayed(t):
    return t.spark.read.parquet(f"{_sunk(t, '0 days')}/deltas").drop("batch")


@query("late_captures")
def late_captures(t):
    return t.spark.read.parquet(f"{_sunk(t, '5 days')}/late").drop("batch")


# ---------------------------------------------------------------------------------------------- workload


@query("query_rollup")
def query_rollup(t):
    return fv.rollup_query_stats(t.query_stats)


@query("plan_divergence")
def plan_divergence(t):
    return fv.plan_divergence(fv.rollup_query_stats(t.query_stats))


@query("top_queries")
def top_queries(t):
    return fv.top_queries(t.query_stats, t.sql_text, t.query_plans, t.databases)


@query("plans_for_query")
def plans_for_query(t):
    return fv.plans_for_query(t.query_stats, t.sql_text, t.query_plans)


@query("index_usage")
def index_usage(t):
    return fv.index_usage(t.index_usage, t.indexes, t.objects, t.schemas).drop("database_id")


# ----------------------------------------------------------------------------------------------- catalog


def _catalog(t: Telemetry) -> fv.Catalog:
    return fv.Catalog(t.objects, t.indexes, t.partitions, t.allocation_units, t.schemas)


@query("object_sizes")
def object_sizes(t):
    return fv.object_sizes(_catalog(t), last_internal_object=-1).drop("database_id")


@query("object_sizes_by_index")
def object_sizes_by_index(t):
    return fv.object_sizes(_catalog(t), by_index=True, last_internal_object=-1).drop("database_id")


@query("object_sizes_rolled_up")
def object_sizes_rolled_up(t):
    return fv.object_sizes(_catalog(t), rollup_rows=True, last_internal_object=-1).drop("database_id")


@query("object_sizes_all")
def object_sizes_all(t):
    return fv.object_sizes_all(_catalog(t), t.databases, last_internal_object=-1).drop("database_id")


@query("object_sizes_named")
def object_sizes_named(t):
    names = "NATION_1, NATION_7,   NATION_12, nowhere"
    return fv.object_sizes_all(_catalog(t), t.databases, names, by_index=True, last_internal_object=-1).drop("database_id")


@query("placement_drift")
def placement_drift(t):
    fv.require_exists(t.filegroups, F.col("name") == "AFRICA", "no such filegroup")
    return fv.placement_drift(t.indexes, t.filegroups, "AFRICA")


@query("secondary_indexes")
def secondary_indexes(t):
    return fv.secondary_indexes(t.indexes)


@query("join_children")
def join_children(t):
    return fv.join_children(t.master_files, "database_id", F.col("physical_name"), ", ", "file_id", "files")


@query("join_lines")
def join_lines(t):
    """The parts of every order, in order of line."""
    return fv.join_children(t.table("lineitem"), "l_orderkey", F.col("l_partkey").cast("string"), ", ", "l_linenumber", "parts")


@query("join_lines_skewed")
def join_lines_skewed(t):
    """Returned lines, about a quarter of all, are children of one parent."""
    parent = F.when(F.col("l_returnflag") == "R", F.lit(-1).cast("bigint")).otherwise(F.col("l_orderkey"))
    lines = t.table("lineitem").withColumn("parent", parent)
    return fv.join_children(lines, "parent", F.col("l_partkey").cast("string"), ";", ["l_orderkey", "l_linenumber"], "parts", trailing=True)


@query("child_pieces")
def child_pieces(t):
    lines = t.table("lineitem")
    return fv.child_pieces(lines, "l_returnflag", F.col("l_partkey").cast("string"), ",", ["l_orderkey", "l_linenumber"], "parts")


@query("collation_scripts")
def collation_scripts(t):
    return fv.collation_scripts(t.databases, t.master_files)


@query("move_commands")
def move_commands(t):
    return fv.move_commands(t.databases, t.master_files, BACKUP_SHARE, BACKUP_FOLDER, DATA_FOLDER)


# ------------------------------------------------------------------------------------------------ ledger


@query("pending_work")
def pending_work(t):
    return fv.pending_work(t.work_catalog, t.work_ledger, exclude=["Customer#000000009"])


@query("extend_ledger")
def extend_ledger(t):
    pending = fv.pending_work(t.work_catalog, t.work_ledger)
    commands = fv.render(pending.withColumnRenamed("name", "dbName"), {"restore_command": "restore {dbName}"})
    return fv.extend_ledger(t.work_ledger, commands, created=AS_OF)


@query("ledger_apply")
def ledger_apply(t):
    return fv.apply_events(t.job_ledger, t.job_events)


@query("ledger_apply_strict")
def ledger_apply_strict(t):
    return fv.apply_events(t.job_ledger, t.job_events, strict_reference=True)


@query("ledger_report")
def ledger_report(t):
    return fv.ledger_report(t.job_ledger)


@query("next_pending")
def next_pending(t):
    return fv.next_pending(t.job_ledger)


# ------------------------------------------------------------------------------------------------- locks


def _inputs(t: Telemetry) -> fv.LockInputs:
    return fv.LockInputs(
        t.tran_locks,
        t.sessions,
        t.connections,
        t.requests,
        t.sql_text,
        t.lock_databases,
        t.lock_partitions,
        t.lock_objects,
    )


def _snapshot(t: Telemetry) -> DataFrame:
    """The snapshot as the reports use it: written once to the work folder, then read as often as needed."""
    return fv.load_or_build(t.spark, scratch_path(t.spark, "locks"), lambda: fv.lock_snapshot(_inputs(t)))


@query("lock_snapshot")
def lock_snapshot(t):
    return fv.lock_snapshot(_inputs(t))


@query("lock_snapshot_strict")
def lock_snapshot_strict(t):
    return fv.lock_snapshot(_inputs(t), system_databases=True, system_sessions=True, strict_reference=True)


@query("wait_pairs_resource")
def wait_pairs_resource(t):
    return fv.wait_pairs(_snapshot(t), "resource")


@query("wait_pairs_blocker")
def wait_pairs_blocker(t):
    return fv.wait_pairs(_snapshot(t), "blocker")


@query("block_join_grid")
def block_join_grid(t):
    """Customers and suppliers of a nation: every nation fills several blocks on a side, so the grid of blocks runs."""
    customers = t.table("customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    suppliers = t.table("supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return fv.block_join(customers, suppliers, ["nation"], block_rows=3)


@query("wait_pair_report")
def wait_pair_report(t):
    return fv.wait_pair_report(fv.wait_pairs(_snapshot(t), "blocker"), "blocker")


@query("holders_by_resource")
def holders_by_resource(t):
    return fv.contention(_snapshot(t), "resource").holders


@query("waiters_by_resource")
def waiters_by_resource(t):
    return fv.contention(_snapshot(t), "resource").waiters


@query("session_overview")
def session_overview(t):
    snapshot = _snapshot(t)
    return fv.session_overview(snapshot, fv.contention(snapshot).holders, t.active_snapshot_tx)


@query("object_overview")
def object_overview(t):
    return fv.object_overview(_snapshot(t))


@query("head_blockers")
def head_blockers(t):
    snapshot = _snapshot(t)
    return fv.head_blockers(snapshot, fv.contention(snapshot, stored=True), once=False, ordered=False)


@query("mid_blockers")
def mid_blockers(t):
    snapshot = _snapshot(t)
    return fv.mid_blockers(snapshot, fv.contention(snapshot, stored=True), once=False, ordered=False)


@query("leaf_waiters")
def leaf_waiters(t):
    snapshot = _snapshot(t)
    return fv.leaf_waiters(snapshot, fv.contention(snapshot, stored=True), once=False, ordered=False)


@query("leaf_waiters_once")
def leaf_waiters_once(t):
    snapshot = _snapshot(t)
    return fv.leaf_waiters(snapshot, fv.contention(snapshot), once=True, ordered=False)


@query("lock_details")
def lock_details(t):
    snapshot = _snapshot(t)
    return fv.lock_details(snapshot, fv.contention(snapshot, stored=True))


@query("lock_details_resource")
def lock_details_resource(t):
    """By resource, many more sessions hold or wait, and the busiest ones in very many places."""
    snapshot = _snapshot(t)
    return fv.lock_details(snapshot, fv.contention(snapshot, "resource", stored=True))


@query("wait_classes_blocker")
def wait_classes_blocker(t):
    return fv.wait_classes(_snapshot(t), "blocker")


@query("wait_classes_resource")
def wait_classes_resource(t):
    return fv.wait_classes(_snapshot(t), "resource")


@query("waiting_sessions_blocker")
def waiting_sessions_blocker(t):
    return fv.waiting_sessions(_snapshot(t), "blocker")


@query("waiting_sessions_resource")
def waiting_sessions_resource(t):
    return fv.waiting_sessions(_snapshot(t), "resource")


@query("blocking_chains_reference")
def blocking_chains_reference(t):
    return fv.blocking_chains(_snapshot(t), "reference")


@query("blocking_chains_full")
def blocking_chains_full(t):
    return fv.blocking_chains(_snapshot(t), "full")


@query("chain_roots")
def chain_roots(t):
    return fv.chain_roots(fv.blocking_edges(_snapshot(t)))


def _circles(t: Telemetry) -> DataFrame:
    """Each customer waits for another, most of them in the end for a circle; one segment waits for nobody."""
    key, most = F.col("c_custkey"), t.table("customer").agg(F.max("c_custkey")).scalar()
    number = (key * 7919 + F.col("c_nationkey") * 104729) % most + 1
    blocker = F.when(F.col("c_mktsegment") != "MACHINERY", number)
    return t.table("customer").select(key.alias("session_id"), blocker.alias("blocking_session_id"))


@query("chain_roots_circles")
def chain_roots_circles(t):
    return fv.chain_roots(_circles(t))


@query("expand_chains")
def expand_chains(t):
    """The paths of the sessions of the largest accounts, in and out of circles."""
    rich = t.table("customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("session_id"))
    return fv.expand_chains(fv.chain_roots(_circles(t)), rich)


@query("session_locks")
def session_locks(t):
    return fv.session_locks(t.tran_locks, t.lock_partitions, t.lock_objects)


@query("blocked_by")
def blocked_by(t):
    return fv.blocked_by(t.requests)


@query("lock_report")
def lock_report(t):
    """The report of the session that blocks most others."""
    most = fv.blocked_by(t.requests).orderBy(F.desc("blocked_sessions_count"), "session_id").first()["session_id"]
    report = fv.lock_report(t.tran_locks, t.requests, t.lock_partitions, t.lock_objects, most)
    return report["locks"].unionByName(report["blocked_locks"])


@query("lock_reports")
def lock_reports(t):
    """The reports of all sessions that block others."""
    return fv.lock_reports(t.tran_locks, t.requests, t.lock_partitions, t.lock_objects)


@query("locking_report")
def locking_report(t):
    """Rows in every section of the detailed report."""
    path = scratch_path(t.spark, "report")
    report = fv.locking_report(_inputs(t), t.active_snapshot_tx, "DETAILED", chains=True, snapshot_path=path, once=False)
    counts = [
        rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(section).alias("section"), "rows")
        for section, rows in report.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _report_text(t: Telemetry, *mode: str, **wanted) -> DataFrame:
    """The whole report in its order: section, row number and the row's columns as one text."""
    report = fv.locking_report(_inputs(t), t.active_snapshot_tx, *mode, **wanted)
    cell = lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("NULL")))
    content = F.array_join(F.transform(F.map_entries("columns"), cell), "|").alias("content")
    return fv.report_table(report).select("section", "row_number", content)


@query("locking_report_overview")
def locking_report_overview(t):
    return _report_text(t)


@query("locking_report_detailed")
def locking_report_detailed(t):
    return _report_text(t, "DETAILED", chains=True)


@query("locking_report_database")
def locking_report_database(t):
    return _report_text(t, "DETAILED", db_name="db_7")


@query("locking_report_database_id")
def locking_report_database_id(t):
    return _report_text(t, db_id=12)


@query("locking_report_session")
def locking_report_session(t):
    return _report_text(t, "DETAILED", spid=7)


@query("locking_report_login")
def locking_report_login(t):
    return _report_text(t, "DETAILED", login="Customer#000000010", system_databases=True, system_sessions=True)


# -------------------------------------------------------------------------------------------------- fleets


@query("wait_delta_fleet")
def wait_delta_fleet(t):
    """Servers report once a day; the last report of each server and wait type counts on either side."""
    events = t.table("events")

    def side(rows: DataFrame) -> DataFrame:
        return rows.groupBy(
            F.concat(F.lit("srv"), (F.col("user_id") % 7).cast("string")).alias("server_id"),
            F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("captured_at"),
            F.col("event_type").alias("wait_type"),
        ).agg(
            F.sum(F.floor(F.col("value") * 1000).cast("bigint")).alias("wait_time_ms"),
            F.sum(F.floor(F.col("value") * 100).cast("bigint")).alias("signal_wait_time_ms"),
            F.count(F.lit(1)).alias("waiting_tasks_count"),
        )

    return fv.wait_delta(side(events.where("ts < timestamp_ntz'2024-01-15 00:00:00'")), side(events))


@query("query_rollup_fleet")
def query_rollup_fleet(t):
    """A server per return flag, a capture per year of shipping."""
    lines = t.table("lineitem")
    time, reads, grant = F.floor("l_extendedprice").cast("bigint"), F.floor("l_quantity").cast("bigint"), F.col("l_suppkey")
    stats = lines.groupBy(
        F.col("l_returnflag").alias("server_id"),
        F.date_trunc("YEAR", "l_shipdate").cast("timestamp_ntz").alias("captured_at"),
        F.col("l_partkey").alias("query_hash"),
        (F.col("l_suppkey") % 5).alias("sql_handle"),
        F.col("l_linenumber").cast("bigint").alias("plan_handle"),
    ).agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.sum(time).alias("total_worker_time"),
        F.min(time).alias("min_worker_time"),
        F.max(time).alias("max_worker_time"),
        F.sum(reads).alias("total_logical_reads"),
        F.min(reads).alias("min_logical_reads"),
        F.max(reads).alias("max_logical_reads"),
        F.sum(grant).alias("total_grant_kb"),
        F.min(grant).alias("min_grant_kb"),
        F.max(grant).alias("max_grant_kb"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("total_spills"),
    )
    kept = ["server_id", "captured_at", "query_hash", "sql_handle", "execution_count", "total_worker_time", "max_worker_time", "min_worker_time"]
    return fv.rollup_query_stats(stats).select(*kept, "total_logical_reads", "plan_handle", "other_plan")


@query("index_usage_fleet")
def index_usage_fleet(t):
    """With the database each index is in."""
    return fv.index_usage(t.index_usage, t.indexes, t.objects, t.schemas)


def _fleet_snapshot(t: Telemetry) -> DataFrame:
    """The same sessions on two servers: what is locked decides which server a lock row is of."""
    server = F.when(F.col("hobt_id") % 2 == 0, F.lit("even")).otherwise(F.lit("odd"))
    return _snapshot(t).withColumn("server_id", server)


@query("session_overview_fleet")
def session_overview_fleet(t):
    snapshot = _fleet_snapshot(t)
    return fv.session_overview(snapshot, fv.contention(snapshot).holders, t.active_snapshot_tx)


@query("lock_details_fleet")
def lock_details_fleet(t):
    snapshot = _fleet_snapshot(t)
    return fv.lock_details(snapshot, fv.contention(snapshot, stored=True))


@query("plans_for_one_query")
def plans_for_one_query(t):
    return fv.plans_for_query(t.query_stats, t.sql_text, t.query_plans, query_hash=7)


@query("plan_divergence_binary")
def plan_divergence_binary(t):
    """Query hashes are bytes, as servers give them."""
    stats = t.query_stats.withColumn("query_hash", F.unhex(F.md5(F.col("query_hash").cast("string"))))
    return fv.plan_divergence(fv.rollup_query_stats(stats)).drop("query_hash")


# ------------------------------------------------------------------------------------------------- tables


@query("generate_tasks")
def generate_tasks(t):
    return fv.generate_tasks(t.table("orders"), as_of=AS_OF).select(
        "task_id", "stage", format_datetime(F.col("valid_to")).alias("valid_to")
    )


@query("generate_sequence")
def generate_sequence(t):
    sequence = fv.generate_sequence(t.table("lineitem"), None, datetime(2020, 1, 1))
    return sequence.withColumns({"i": F.col("i").cast("int"), "d": F.col("d").cast("timestamp_ntz")})


@query("numbered_orders")
def numbered_orders(t):
    """Orders numbered by date in their customer."""
    orders = t.table("orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return fv.number_rows(orders, [F.desc("o_orderdate"), "o_orderkey"], within=["o_custkey"])


@query("numbered_lines")
def numbered_lines(t):
    """All lines numbered by date: one group, many ties."""
    lines = t.table("lineitem").select("l_shipdate", "l_orderkey", "l_linenumber")
    return fv.number_rows(lines, ["l_shipdate", "l_orderkey", "l_linenumber"])


@query("repeated_lines")
def repeated_lines(t):
    """Each line as often as its quantity in tens says."""
    lines = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return fv.repeat_rows(lines, F.floor(F.col("l_quantity") / 10))


@query("sample_exact")
def sample_exact(t):
    return fv.sample_exact(t.tasks)


@query("update_where_in")
def update_where_in(t):
    picked = fv.sample_exact(t.tasks)
    return fv.update_where_in(t.tasks, picked, "uuid", {"stage": F.col("stage") + 1})


@query("update_all")
def update_all(t):
    return fv.update_all(t.tasks, {"valid_to": fv.add_seconds("valid_to", "task_id")})


@query("delete_where")
def delete_where(t):
    return fv.delete_expired(t.tasks, as_of=AS_OF)


@query("repeat_update")
def repeat_update(t):
    return fv.repeat_update(t.tasks)


@query("with_defaults")
def with_defaults(t):
    filled = fv.with_defaults(t.tasks.select("task_id", "stage"), as_of=AS_OF)
    return filled.select(
        "task_id", "stage", F.length("uuid").alias("key_length"), format_datetime(F.col("valid_to")).alias("valid_to")
    )


@query("with_defaults_now")
def with_defaults_now(t):
    """Without a given time the present one is filled in."""
    filled = fv.with_defaults(t.tasks.select("task_id", "stage"))
    now = F.current_timestamp()
    recent = F.col("valid_to").cast("timestamp").between(now - F.expr("INTERVAL 1 HOUR"), now)
    return filled.select("task_id", "stage", F.length("uuid").alias("key_length"), recent.alias("is_recent"))


@query("top_k")
def top_k(t):
    return fv.top_k(t.sequence, ["d", "i"])


@query("top_k_by_key")
def top_k_by_key(t):
    return fv.top_k(t.sequence, "i", 10_000)


@query("fixed_width")
def fixed_width(t):
    return fv.to_fixed_width(t.sequence, "v", 7)


@query("top_k_fixed_width")
def top_k_fixed_width(t):
    return fv.top_k(fv.to_fixed_width(t.sequence, "v", 7), ["d", "i"])
