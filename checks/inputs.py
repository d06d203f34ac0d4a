"""Telemetry relations derived from the given Parquet tables (see FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def whole(value: Column) -> Column:
    """Floor first: engines differ in how a fraction is cast to a whole number."""
    return F.floor(value).cast("bigint")


def total(value: Column, name: str) -> Column:
    return F.sum(value).cast("bigint").alias(name)


class Telemetry:
    """The relations at one scale; every property is a lazy frame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    # ------------------------------------------------------------------------------------- counters

    def _waits(self, rows: DataFrame) -> DataFrame:
        kind = F.concat("event_type", F.lit("#"), F.col("user_id").cast("string"))
        return rows.groupBy(kind.alias("wait_type")).agg(
            total(whole(F.col("value") * 1000), "wait_time_ms"),
            total(whole(F.col("value") * 100), "signal_wait_time_ms"),
            F.count(F.lit(1)).alias("waiting_tasks_count"),
        )

    @property
    def waits_before(self) -> DataFrame:
        return self._waits(self.table("events").where("ts < timestamp_ntz'2024-01-28 00:00:00'"))

    @property
    def waits_after(self) -> DataFrame:
        """Counters only grow: the later capture holds all events."""
        return self._waits(self.table("events"))

    @property
    def ignored(self) -> DataFrame:
        kind = F.concat("event_type", F.lit("#"), F.col("user_id").cast("string"))
        return self.table("events").where("event_type = 'signup'").select(kind.alias("wait_type")).distinct()

    @property
    def wait_history(self) -> DataFrame:
        kind = F.concat("event_type", F.lit("#"), F.col("user_id").cast("string"))
        return (
            self.table("events")
            .groupBy(kind.alias("wait_type"), F.date_trunc("HOUR", "ts").cast("timestamp_ntz").alias("captured_at"))
            .agg(
                total(whole(F.col("value") * 1000), "wait_time_ms"),
                F.count(F.lit(1)).alias("waiting_tasks_count"),
            )
        )

    @property
    def databases(self) -> DataFrame:
        return self.table("nation").select(
            F.col("n_nationkey").alias("database_id"),
            F.col("n_name").alias("name"),
            F.when(F.col("n_regionkey") == 4, F.lit("OFFLINE")).otherwise(F.lit("ONLINE")).alias("state_desc"),
        )

    @property
    def master_files(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_nationkey").alias("database_id"),
            F.col("s_suppkey").alias("file_id"),
            F.when(F.col("s_acctbal") < 1000, F.lit("LOG")).otherwise(F.lit("ROWS")).alias("type_desc"),
            F.col("s_name").alias("name"),
            F.concat(F.lit("D:\\data\\"), "s_name", F.lit(".mdf")).alias("physical_name"),
        )

    def _file_stats(self, until: str) -> DataFrame:
        items = self.table("lineitem").where(f"l_shipdate < timestamp_ntz'{until} 00:00:00'")
        # files of an overdrawn supplier report together, under no file of their own
        file_id = F.when(F.col("s_acctbal") >= 0, F.col("s_suppkey")).alias("file_id")
        owner = self.table("supplier").select("s_suppkey", F.col("s_nationkey").alias("database_id"), file_id)
        read = F.col("l_linestatus") == "F"
        size = whole(F.col("l_quantity")) * 8192
        stall = F.col("l_partkey") % 50
        sums = {
            "size_on_disk_bytes": whole(F.col("l_extendedprice")),
            "num_of_reads": F.when(read, 1).otherwise(0),
            "num_of_bytes_read": F.when(read, size).otherwise(0),
            "io_stall_read_ms": F.when(read, stall).otherwise(0),
            "num_of_writes": F.when(~read, 1).otherwise(0),
            "num_of_bytes_written": F.when(~read, size).otherwise(0),
            "io_stall_write_ms": F.when(~read, stall).otherwise(0),
            "io_stall": stall,
        }
        by_supplier = items.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(*[total(value, name) for name, value in sums.items()])
        return by_supplier.join(owner, "s_suppkey").groupBy("database_id", "file_id").agg(*[total(F.col(name), name) for name in sums])

    @property
    def file_stats_before(self) -> DataFrame:
        return self._file_stats("1998-01-01")

    @property
    def file_stats_after(self) -> DataFrame:
        return self._file_stats("2002-01-01")

    # ------------------------------------------------------------------------------------- workload

    @property
    def query_stats(self) -> DataFrame:
        time, reads, grant = whole(F.col("l_extendedprice")), whole(F.col("l_quantity")), F.col("l_suppkey")
        return (
            self.table("lineitem")
            .groupBy(
                F.col("l_partkey").alias("query_hash"),
                (F.col("l_suppkey") % 5).alias("sql_handle"),
                F.col("l_linenumber").cast("bigint").alias("plan_handle"),
            )
            .agg(
                F.count(F.lit(1)).alias("execution_count"),
                total(time, "total_worker_time"),
                F.min(time).alias("min_worker_time"),
                F.max(time).alias("max_worker_time"),
                total(reads, "total_logical_reads"),
                F.min(reads).alias("min_logical_reads"),
                F.max(reads).alias("max_logical_reads"),
                total(grant, "total_grant_kb"),
                F.min(grant).alias("min_grant_kb"),
                F.max(grant).alias("max_grant_kb"),
                total(F.when(F.col("l_returnflag") == "R", 1).otherwise(0), "total_spills"),
            )
        )

    @property
    def sql_text(self) -> DataFrame:
        return (
            self.table("supplier")
            .where("s_acctbal >= 1000")
            .select(
                F.col("s_suppkey").alias("sql_handle"),
                F.col("s_name").alias("text"),
                F.when(F.col("s_acctbal") < 5000, F.col("s_nationkey")).alias("dbid"),
            )
        )

    @property
    def query_plans(self) -> DataFrame:
        number = F.col("l_linenumber")
        return (
            self.table("lineitem")
            .select(number)
            .distinct()
            .select(
                number.cast("bigint").alias("plan_handle"),
                F.concat(F.lit("plan "), number.cast("string")).alias("query_plan"),
                number.alias("dbid"),
            )
        )

    # -------------------------------------------------------------------------------------- catalog

    @property
    def schemas(self) -> DataFrame:
        return (
            self.table("nation")
            .where("n_regionkey <> 3")
            .select(F.col("n_nationkey").alias("schema_id"), F.col("n_name").alias("name"))
        )

    @property
    def objects(self) -> DataFrame:
        return self.table("supplier").select(
            F.col("s_suppkey").alias("object_id"),
            F.col("s_nationkey").alias("schema_id"),
            F.col("s_name").alias("name"),
            (F.col("s_acctbal") < 0).alias("is_ms_shipped"),
            F.col("s_nationkey").alias("database_id"),
        )

    @property
    def indexes(self) -> DataFrame:
        number = F.col("l_linenumber")
        return (
            self.table("lineitem")
            .select("l_suppkey", "l_linenumber")
            .distinct()
            .select(
                F.col("l_suppkey").alias("object_id"),
                (number - 1).alias("index_id"),
                F.concat(F.lit("ix_"), number.cast("string")).alias("name"),
                ((F.col("l_suppkey") + number) % 3).cast("int").alias("data_space_id"),
                (number == 1).alias("is_unique"),
                ((F.col("l_suppkey") + number) % 4 == 0).alias("is_disabled"),
            )
        )

    @property
    def filegroups(self) -> DataFrame:
        return self.table("region").select(
            F.col("r_regionkey").alias("data_space_id"), F.col("r_name").alias("name")
        )

    @property
    def partitions(self) -> DataFrame:
        id_ = F.col("l_suppkey") * 10 + F.col("l_linenumber")
        big = (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)
        return (
            self.table("lineitem")
            .groupBy("l_suppkey", "l_linenumber")
            .agg(total(F.when(big, 1).otherwise(0), "rows"))
            .select(
                F.col("l_suppkey").alias("object_id"),
                (F.col("l_linenumber") - 1).alias("index_id"),
                id_.alias("partition_id"),
                id_.alias("hobt_id"),
                "rows",
            )
        )

    @property
    def allocation_units(self) -> DataFrame:
        id_ = F.col("l_suppkey") * 10 + F.col("l_linenumber")
        return (
            self.table("lineitem")
            .groupBy(id_.alias("container_id"), "l_returnflag")
            .agg(total(whole(F.col("l_quantity")), "total_pages"), F.count(F.lit(1)).alias("used_pages"))
            .drop("l_returnflag")
        )

    @property
    def index_usage(self) -> DataFrame:
        owner = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        flag = F.col("l_returnflag")
        used = (
            self.table("lineitem")
            .groupBy("l_suppkey", "l_linenumber")
            .agg(
                total(F.when(flag == "A", 1).otherwise(0), "user_seeks"),
                total(F.when(flag == "N", 1).otherwise(0), "user_scans"),
                total(F.when(flag == "R", 1).otherwise(0), "user_lookups"),
                F.count(F.lit(1)).alias("user_updates"),
            )
        )
        return used.join(owner, "l_suppkey").select(
            F.col("s_nationkey").alias("database_id"),
            F.col("l_suppkey").alias("object_id"),
            (F.col("l_linenumber") - 1).alias("index_id"),
            "user_seeks",
            "user_scans",
            "user_lookups",
            "user_updates",
        )

    # ---------------------------------------------------------------------------------------- locks

    @property
    def _held_lines(self) -> DataFrame:
        """Lines with the customer of their order, by part: the lock rows and the requests share the shuffles of the lines.

        Customer, line number, flag and status go by part as one number: a column costs more than its values there, and a
        customer that is null is a bit of it; customer keys beyond 2^55 fail.
        """
        flag, status = F.col("l_returnflag"), F.col("l_linestatus")
        held = F.when(status == "F", 1).when(status.isNull(), 2).otherwise(0)
        packed = F.col("l_linenumber").cast("bigint") * 9 + F.when(flag == "A", 0).when(flag == "N", 3).otherwise(6) + held
        lines = self.table("lineitem").select("l_orderkey", "l_partkey", packed.alias("packed"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        known = lines.where((self._kind(F.col("packed")) != "DATABASE") & F.col("l_partkey").isNotNull()).join(orders, "l_orderkey")
        session = F.col("o_custkey").cast("bigint")
        whole = F.coalesce(session * 256, F.lit(128)) + F.col("packed")
        return known.select("l_partkey", whole.alias("packed")).repartition("l_partkey")

    @staticmethod
    def _kind(packed: Column) -> Column:
        kinds = F.array(*[F.lit(k) for k in ("OBJECT", "PAGE", "EXTENT", "KEY", "RID", "HOBT", "METADATA")])
        return F.element_at(kinds, F.floor(packed / 9).cast("int"))

    @staticmethod
    def _unpacked() -> tuple[Column, Column]:
        """Session and the rest of what ``_held_lines`` packs."""
        packed = F.col("packed")
        return F.when(packed.bitwiseAND(F.lit(128)) == 0, F.shiftright(packed, 8)), packed.bitwiseAND(F.lit(127))

    @property
    def tran_locks(self) -> DataFrame:
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_size")
        session, packed = self._unpacked()
        number, state = F.floor(packed / 9).cast("int"), F.pmod(packed, F.lit(9))
        granted, mode = state % 3 == 1, F.floor(state / 3)
        waits = F.when(mode == 1, F.lit("CONVERT")).otherwise(F.lit("WAIT"))
        return self._held_lines.join(parts, "l_partkey").select(
            self._kind(packed).alias("resource_type"),
            number.cast("string").alias("resource_description"),
            F.col("l_partkey").alias("resource_associated_entity_id"),
            F.col("p_size").alias("resource_database_id"),
            F.lit("LOCK").alias("request_type"),
            F.when(granted, F.lit("GRANT")).otherwise(waits).alias("request_status"),
            F.when(mode == 0, F.lit("S")).when(mode == 1, F.lit("IX")).otherwise(F.lit("X")).alias("request_mode"),
            session.alias("request_session_id"),
        )

    @property
    def lock_databases(self) -> DataFrame:
        named = self.table("part").where("p_size < 50").select("p_size").distinct()
        return named.select(
            F.col("p_size").alias("database_id"),
            F.concat(F.lit("db_"), F.col("p_size").cast("string")).alias("name"),
            F.lit("ONLINE").alias("state_desc"),
        )

    @property
    def lock_partitions(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_size").alias("database_id"),
            F.col("p_partkey").alias("object_id"),
            F.col("p_partkey").alias("hobt_id"),
        )

    @property
    def lock_objects(self) -> DataFrame:
        return (
            self.table("part")
            .where("p_type <> 'PROMO'")
            .select(
                F.col("p_size").alias("database_id"),
                F.col("p_partkey").alias("object_id"),
                F.col("p_brand").alias("name"),
            )
        )

    @property
    def sessions(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("session_id"),
            F.col("c_name").alias("login_name"),
            F.col("c_mktsegment").alias("host_name"),
            F.when(F.col("c_acctbal") < 3000, F.lit("sleeping")).otherwise(F.lit("running")).alias("status"),
            (F.col("c_nationkey") % 4).alias("open_transaction_count"),
            (F.col("c_nationkey") % 7).alias("transaction_isolation_level"),
            F.when(F.col("c_acctbal") < -500, 0).otherwise(1).alias("is_user_process"),
        )

    @property
    def connections(self) -> DataFrame:
        return (
            self.table("customer")
            .where("c_mktsegment <> 'MACHINERY'")
            .select(
                F.col("c_custkey").alias("session_id"),
                F.col("c_nationkey").cast("bigint").alias("most_recent_sql_handle"),
            )
        )

    @property
    def requests(self) -> DataFrame:
        """A waiting session is blocked by the lowest session below it that holds what it waits for."""
        session, packed = self._unpacked()
        number, state = F.floor(packed / 9), F.pmod(packed, F.lit(9)) % 3
        # the lock rows of a snapshot have a type and a session; said here too, so that both read one shuffle
        rows = self._held_lines.where((self._kind(packed) != "DATABASE") & session.isNotNull()).select(
            "l_partkey",
            number.alias("l_linenumber"),
            session.alias("session"),
            F.when(state == 1, session).alias("holder"),
            F.when(state == 0, session).alias("waiter"),
        )
        # lines lie by part already, so a window moves none of them; holders below a session come before it
        below = Window.partitionBy("l_partkey", "l_linenumber").orderBy("session").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        least = F.min("holder").over(below)
        blockers = (
            rows.withColumn("least", least)
            .where("waiter is not null and least < waiter")
            .groupBy(F.col("waiter").alias("session_id"))
            .agg(F.min("least").alias("blocking_session_id"))
        )
        return (
            self.table("customer")
            .where("c_acctbal >= 0")
            .select(
                F.col("c_custkey").alias("session_id"),
                F.when(F.col("c_acctbal") >= 2000, F.col("c_nationkey") % 7).alias("transaction_isolation_level"),
            )
            .join(blockers, "session_id", "left")
            .select("session_id", "blocking_session_id", "transaction_isolation_level")
        )

    @property
    def active_snapshot_tx(self) -> DataFrame:
        return (
            self.table("customer")
            .where("c_mktsegment = 'BUILDING'")
            .select(F.col("c_custkey").alias("session_id"))
        )

    # ------------------------------------------------------------------------------ ledger and tasks

    @property
    def work_catalog(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("database_id"),
            F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "MACHINERY", F.lit("OFFLINE")).otherwise(F.lit("ONLINE")).alias("state_desc"),
        )

    @property
    def work_ledger(self) -> DataFrame:
        """Customers with a large finished order are on the ledger already."""
        names = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
        return (
            self.table("orders")
            .where("o_orderstatus = 'F' and o_totalprice > 400000")
            .join(names, "o_custkey")
            .groupBy(F.col("c_name").alias("dbName"))
            .agg(F.min("o_orderdate").alias("start_dt"))
            .select(
                "dbName",
                F.lit(None).cast("string").alias("restore_command"),
                F.lit(0).alias("processed"),
                F.lit(None).cast("timestamp_ntz").alias("creation_dt"),
                "start_dt",
                F.col("start_dt").alias("finish_dt"),
                F.lit(None).cast("string").alias("error_msg"),
            )
        )

    @property
    def job_ledger(self) -> DataFrame:
        status = F.col("o_orderstatus")
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("dbName"),
            F.concat(F.lit("restore "), F.col("o_orderkey").cast("string")).alias("restore_command"),
            F.when(status == "F", 0).when(status == "O", 1).alias("processed"),
            F.col("o_orderdate").alias("start_dt"),
            F.lit(None).cast("timestamp_ntz").alias("finish_dt"),
            F.when(status == "O", F.col("o_orderpriority")).alias("error_msg"),
        )

    @property
    def job_events(self) -> DataFrame:
        flag = F.col("l_returnflag")
        kind = F.when(flag == "A", F.lit("succeeded")).when(flag == "N", F.lit("started")).otherwise(F.lit("failed"))
        message = F.concat(F.lit("step "), F.col("l_linenumber").cast("string"))
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("dbName"),
            F.col("l_shipdate").alias("event_dt"),
            kind.alias("event"),
            F.when(flag == "R", message).alias("error_msg"),
        )

    @property
    def tasks(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            F.md5(key.cast("string")).alias("uuid"),
            key.alias("task_id"),
            (key % 10).cast("int").alias("stage"),
            F.col("o_orderdate").alias("valid_to"),
        )

    @property
    def sequence(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(
            key.cast("int").alias("i"), F.col("o_orderdate").alias("d"), key.cast("string").alias("v")
        )
