"""Query and index statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.functions import CATALOG_SCOPE, div, half_up, scope_of, trimmed_mean
from fleetvitals.operators.filters import optional_filter
from fleetvitals.plans import durable

# Shown when a query has one plan (fixed value).
SINGLE_PLAN = "there is only one plan in cache, you see everything"

DRILL_DOWN = """SELECT st.text, qp.query_plan, qs.execution_count,
       qs.total_worker_time div 1000 AS total_worker_time, qs.total_logical_reads,
       qs.total_grant_kb div 1024 AS total_grant_MB, qs.total_spills
FROM query_stats qs
LEFT JOIN sql_text st ON st.sql_handle = qs.sql_handle
LEFT JOIN query_plans qp ON qp.plan_handle = qs.plan_handle
WHERE qs.query_hash = """


def rollup_query_stats(query_stats: DataFrame) -> DataFrame:
    """Plan rows summed to (query_hash, sql_handle).

    ``plan_handle`` and ``other_plan`` are the greatest and the least handle: equal for a single plan.
    """
    keys = [*scope_of(query_stats), "query_hash", "sql_handle"]
    sums = query_stats.groupBy(*keys).agg(
        F.sum("execution_count").alias("execution_count"),
        F.sum("total_worker_time").alias("total_worker_time"),
        F.max("max_worker_time").alias("max_worker_time"),
        F.min("min_worker_time").alias("min_worker_time"),
        F.sum("total_logical_reads").alias("total_logical_reads"),
        F.min("min_logical_reads").alias("min_logical_reads"),
        F.max("max_logical_reads").alias("max_logical_reads"),
        F.sum("total_grant_kb").alias("_total_kb"),
        F.min("min_grant_kb").alias("_min_kb"),
        F.max("max_grant_kb").alias("_max_kb"),
        F.sum("total_spills").alias("total_spills"),
        F.max("plan_handle").alias("plan_handle"),
        F.min("plan_handle").alias("other_plan"),
    )
    for part in ("total", "min", "max"):
        sums = sums.withColumn(f"{part}_grant_MB", half_up(F.col(f"_{part}_kb"), 1024, 4))
    return sums.drop("_total_kb", "_min_kb", "_max_kb")


def _literal(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "binary":
        return F.concat(F.lit("X'"), F.hex(name), F.lit("'"))
    return F.col(name).cast("string")


def plan_divergence(rollup: DataFrame) -> DataFrame:
    """Whether a query has more than one plan, and the text that lists them when it has."""
    one = F.col("plan_handle") == F.col("other_plan")
    return rollup.select(
        *scope_of(rollup),
        "query_hash",
        "sql_handle",
        F.coalesce(~one, F.lit(True)).alias("has_other_plans"),
        diagnosis(rollup).alias("diagnosis_query"),
    )


def diagnosis(rollup: DataFrame) -> Column:
    """The single-plan message, or a drill-down query over the telemetry views."""
    one = F.col("plan_handle") == F.col("other_plan")
    return F.when(one, F.lit(SINGLE_PLAN)).otherwise(F.concat(F.lit(DRILL_DOWN), _literal(rollup, "query_hash")))


def _lookup(
    rows: DataFrame, table: DataFrame, on: str, handles: DataFrame | None, **columns: str
) -> DataFrame:
    """Left join that keeps misses and takes one row per handle.

    With ``handles``, only those handles of the table are read beyond the scan.
    """
    keys = [*scope_of(rows, table), on]
    if handles is not None:
        table = table.join(handles.select(*keys), keys, "left_semi")
    # texts and plans go through no aggregate: the first row is found by rank, cut to one per key in every task
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*columns))
    first = table.withColumn("_rank", rank).where("_rank = 1")
    return rows.join(first.select(*keys, *[F.col(c).alias(name) for c, name in columns.items()]), keys, "left")


def _with_text(
    rows: DataFrame, sql_text: DataFrame, query_plans: DataFrame, handles: DataFrame | None
) -> DataFrame:
    rows = _lookup(rows, sql_text, "sql_handle", handles, text="query_text", dbid="_text_db")
    return _lookup(rows, query_plans, "plan_handle", handles, query_plan="query_plan", dbid="_plan_db")


def top_queries(
    query_stats: DataFrame, sql_text: DataFrame, query_plans: DataFrame, databases: DataFrame, n: int = 100
) -> DataFrame:
    """The ``n`` most executed queries with text, plan, database and per-execution figures.

    The top rows are picked and kept (``n`` rows) before anything is looked up, so text and plans are
    shuffled for those rows only.  Rows with equal counts are ordered by query hash and handle.
    """
    order = [F.desc("execution_count"), "query_hash", "sql_handle"]
    top = durable(rollup_query_stats(query_stats).orderBy(*order).limit(n))
    found = _with_text(top, sql_text, query_plans, top)
    scope = scope_of(found, databases)
    names = databases.select(
        *scope, F.col("database_id").alias("_db").cast("bigint"), F.col("name").alias("database_name")
    )
    found = found.withColumn("_db", F.coalesce("_text_db", "_plan_db").cast("bigint"))
    found = found.join(names, [*scope, "_db"], "left")
    n_runs = F.col("execution_count")
    mean_ms = trimmed_mean(
        F.col("total_worker_time"), F.col("min_worker_time"), F.col("max_worker_time"), n_runs, 1000
    )
    mean_reads = trimmed_mean(
        F.col("total_logical_reads"), F.col("min_logical_reads"), F.col("max_logical_reads"), n_runs
    )
    # total_grant_MB has four decimals: its ten-thousandths are whole
    grant = (F.col("total_grant_MB") * 10_000).cast("bigint")
    return found.orderBy(*order).select(
        *scope_of(query_stats),
        "database_name",
        "query_text",
        "query_plan",
        "execution_count",
        mean_ms.alias("avg_time_ms"),
        div(F.col("min_worker_time"), 1000).alias("min_time_ms"),
        div(F.col("max_worker_time"), 1000).alias("max_time_ms"),
        div(F.col("total_worker_time"), 1000).alias("total_time_ms"),
        mean_reads.alias("avg_logical_reads"),
        "min_logical_reads",
        "max_logical_reads",
        "total_logical_reads",
        half_up(grant, n_runs * 10_000, 4).alias("avg_grant_MB"),
        "min_grant_MB",
        "max_grant_MB",
        "total_spills",
        diagnosis(found).alias("diagnosis_query"),
    )


def plans_for_query(
    query_stats: DataFrame, sql_text: DataFrame, query_plans: DataFrame, query_hash: object = None
) -> DataFrame:
    """One row per cached plan of a query, or of every query when no hash is given."""
    picked = optional_filter(query_stats, query_hash=query_hash)
    found = _with_text(picked, sql_text, query_plans, None if query_hash is None else picked)
    return found.select(
        *scope_of(query_stats),
        "query_hash",
        F.col("query_text").alias("text"),
        "query_plan",
        "execution_count",
        div(F.col("total_worker_time"), 1000).alias("total_worker_time"),
        "total_logical_reads",
        div(F.col("total_grant_kb"), 1024).alias("total_grant_MB"),
        "total_spills",
    )


def index_usage(
    usage: DataFrame,
    indexes: DataFrame,
    objects: DataFrame,
    schemas: DataFrame,
    database_id: int | None = None,
) -> DataFrame:
    """Use of each index in one database, or in all of them when no id is given.

    Indexes nobody used have no usage row and are absent.  Where catalog frames carry ``database_id``,
    they are matched on it too.
    """
    used = optional_filter(usage, database_id=database_id)
    on_index = [*scope_of(used, indexes, names=CATALOG_SCOPE), "object_id", "index_id"]
    named = used.join(indexes.select(*on_index, F.col("name").alias("index_name")), on_index)
    on_object = [*scope_of(named, objects, names=CATALOG_SCOPE), "object_id"]
    named = named.join(objects.select(*on_object, "schema_id", F.col("name").alias("_object")), on_object)
    on_schema = [*scope_of(named, schemas, names=CATALOG_SCOPE), "schema_id"]
    named = named.join(schemas.select(*on_schema, F.col("name").alias("_schema")), on_schema)
    return named.select(
        *scope_of(usage, names=CATALOG_SCOPE),
        F.concat("_schema", F.lit("."), "_object").alias("table_name"),
        "index_name",
        "user_seeks",
        "user_scans",
        "user_lookups",
        "user_updates",
    )
