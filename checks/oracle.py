"""

``RELATIONS`` derives the telemetry relations from the given tables; ``_sql`` puts those that a query
names in front of it.
"""

from __future__ import annotations

import re

from checks.report_sql import report_sql

# The texts that results must contain (fixed values).
STATUS_TEXTS = {1: "Ошибка", 0: "Успешно", None: "Не обработано"}
SINGLE_PLAN = "there is only one plan in cache, you see everything"
DRILL_DOWN = """SELECT st.text, qp.query_plan, qs.execution_count,
       qs.total_worker_time div 1000 AS total_worker_time, qs.total_logical_reads,
       qs.total_grant_kb div 1024 AS total_grant_MB, qs.total_spills
FROM query_stats qs
LEFT JOIN sql_text st ON st.sql_handle = qs.sql_handle
LEFT JOIN query_plans qp ON qp.plan_handle = qs.plan_handle
WHERE qs.query_hash = """

# ------------------------------------------------------------------------------------------- telemetry

_WAITS = """
SELECT event_type || '#' || CAST(user_id AS VARCHAR) AS wait_type,
       CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS wait_time_ms,
       CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS signal_wait_time_ms,
       count(*) AS waiting_tasks_count
FROM events WHERE {period} GROUP BY 1"""

_FILE_STATS = """
SELECT s_nationkey AS database_id, CASE WHEN s_acctbal >= 0 THEN l_suppkey END AS file_id,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS size_on_disk_bytes,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS num_of_reads,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_quantity) AS BIGINT) * 8192 ELSE 0 END) AS BIGINT)
         AS num_of_bytes_read,
       CAST(sum(CASE WHEN l_linestatus = 'F' THEN l_partkey % 50 ELSE 0 END) AS BIGINT) AS io_stall_read_ms,
       CAST(sum(CASE WHEN l_linestatus <> 'F' THEN 1 ELSE 0 END) AS BIGINT) AS num_of_writes,
       CAST(sum(CASE WHEN l_linestatus <> 'F' THEN CAST(floor(l_quantity) AS BIGINT) * 8192 ELSE 0 END) AS BIGINT)
         AS num_of_bytes_written,
       CAST(sum(CASE WHEN l_linestatus <> 'F' THEN l_partkey % 50 ELSE 0 END) AS BIGINT) AS io_stall_write_ms,
       CAST(sum(l_partkey % 50) AS BIGINT) AS io_stall
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
WHERE l_shipdate < TIMESTAMP '{until}'
GROUP BY 1, 2"""

RELATIONS = {
    "waits_before": _WAITS.format(period="ts < TIMESTAMP '2024-01-28'"),
    "waits_after": _WAITS.format(period="true"),
    "active_before": """
SELECT * FROM waits_before
WHERE wait_type NOT LIKE 'signup#%' AND waiting_tasks_count > 0""",
    "active_after": """
SELECT * FROM waits_after
WHERE wait_type NOT LIKE 'signup#%' AND waiting_tasks_count > 0""",
    "deltas": """
SELECT * FROM (
  SELECT wait_type, abs(ifnull(a.wait_time_ms, 0) - ifnull(b.wait_time_ms, 0)) AS wait_time_ms,
         abs(ifnull(a.signal_wait_time_ms, 0) - ifnull(b.signal_wait_time_ms, 0)) AS signal_wait_time_ms,
         abs(ifnull(a.waiting_tasks_count, 0) - ifnull(b.waiting_tasks_count, 0)) AS wait_count
  FROM active_before b FULL JOIN active_after a USING (wait_type))
WHERE wait_count > 0""",
    "wait_history": """
SELECT event_type || '#' || CAST(user_id AS VARCHAR) AS wait_type, date_trunc('hour', ts) AS captured_at,
       CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS wait_time_ms, count(*) AS waiting_tasks_count
FROM events GROUP BY 1, 2""",
    "dbs": """
SELECT n_nationkey AS database_id, n_name AS name,
       CASE WHEN n_regionkey = 4 THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc FROM nation""",
    "files": """
SELECT s_nationkey AS database_id, s_suppkey AS file_id,
       CASE WHEN s_acctbal < 1000 THEN 'LOG' ELSE 'ROWS' END AS type_desc, s_name AS name,
       'D:\\data\\' || s_name || '.mdf' AS physical_name FROM supplier""",
    "file_stats_before": _FILE_STATS.format(until="1998-01-01"),
    "file_stats_after": _FILE_STATS.format(until="2002-01-01"),
    "io_before": """
SELECT d.name, f.file_id, f.type_desc, s.* EXCLUDE (database_id, file_id)
FROM dbs d JOIN files f ON d.database_id = f.database_id
LEFT JOIN file_stats_before s ON f.database_id = s.database_id AND f.file_id = s.file_id""",
    "io_after": """
SELECT d.name, f.file_id, f.type_desc, s.* EXCLUDE (database_id, file_id)
FROM dbs d JOIN files f ON d.database_id = f.database_id
LEFT JOIN file_stats_after s ON f.database_id = s.database_id AND f.file_id = s.file_id""",
    "io_change": """
SELECT a.name, a.file_id, a.type_desc, a.size_on_disk_bytes,
       a.num_of_reads - b.num_of_reads AS r, a.num_of_bytes_read - b.num_of_bytes_read AS rb,
       a.io_stall_read_ms - b.io_stall_read_ms AS rs,
       a.num_of_writes - b.num_of_writes AS w, a.num_of_bytes_written - b.num_of_bytes_written AS wb,
       a.io_stall_write_ms - b.io_stall_write_ms AS ws, a.io_stall - b.io_stall AS st
FROM io_after a JOIN io_before b ON a.name = b.name AND a.file_id = b.file_id""",
    "query_stats": """
SELECT l_partkey AS query_hash, l_suppkey % 5 AS sql_handle, CAST(l_linenumber AS BIGINT) AS plan_handle,
       count(*) AS execution_count,
       CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_worker_time,
       min(CAST(floor(l_extendedprice) AS BIGINT)) AS min_worker_time,
       max(CAST(floor(l_extendedprice) AS BIGINT)) AS max_worker_time,
       CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total_logical_reads,
       min(CAST(floor(l_quantity) AS BIGINT)) AS min_logical_reads,
       max(CAST(floor(l_quantity) AS BIGINT)) AS max_logical_reads,
       CAST(sum(l_suppkey) AS BIGINT) AS total_grant_kb, min(l_suppkey) AS min_grant_kb,
       max(l_suppkey) AS max_grant_kb,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS total_spills
FROM lineitem GROUP BY 1, 2, 3""",
    "texts": """
SELECT s_suppkey AS sql_handle, s_name AS text, CASE WHEN s_acctbal < 5000 THEN s_nationkey END AS dbid
FROM supplier WHERE s_acctbal >= 1000""",
    "plans": """
SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS plan_handle, 'plan ' || CAST(l_linenumber AS VARCHAR) AS query_plan,
       l_linenumber AS dbid FROM lineitem""",
    "stats": """
SELECT query_hash, sql_handle, CAST(sum(execution_count) AS BIGINT) AS execution_count,
       CAST(sum(total_worker_time) AS BIGINT) AS total_worker_time, max(max_worker_time) AS max_worker_time,
       min(min_worker_time) AS min_worker_time, CAST(sum(total_logical_reads) AS BIGINT) AS total_logical_reads,
       min(min_logical_reads) AS min_logical_reads, max(max_logical_reads) AS max_logical_reads,
       CAST(sum(total_spills) AS BIGINT) AS total_spills,
       max(plan_handle) AS plan_handle, min(plan_handle) AS other_plan,
       {total_mb} AS total_grant_MB, {min_mb} AS min_grant_MB, {max_mb} AS max_grant_MB
FROM query_stats GROUP BY 1, 2""",
    "schems": "SELECT n_nationkey AS schema_id, n_name AS name FROM nation WHERE n_regionkey <> 3",
    "objs": """
SELECT s_suppkey AS object_id, s_nationkey AS schema_id, s_name AS name, s_acctbal < 0 AS is_ms_shipped,
       s_nationkey AS database_id FROM supplier""",
    "idx": """
SELECT DISTINCT l_suppkey AS object_id, l_linenumber - 1 AS index_id,
       'ix_' || CAST(l_linenumber AS VARCHAR) AS name,
       CAST((l_suppkey + l_linenumber) % 3 AS INTEGER) AS data_space_id, l_linenumber = 1 AS is_unique,
       (l_suppkey + l_linenumber) % 4 = 0 AS is_disabled FROM lineitem""",
    "groups_": "SELECT r_regionkey AS data_space_id, r_name AS name FROM region",
    "parts": """
SELECT l_suppkey AS object_id, l_linenumber - 1 AS index_id, l_suppkey * 10 + l_linenumber AS partition_id,
       CAST(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS "rows"
FROM lineitem GROUP BY 1, 2, 3""",
    "units": """
SELECT l_suppkey * 10 + l_linenumber AS container_id,
       CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total_pages, count(*) AS used_pages
FROM lineitem GROUP BY l_suppkey * 10 + l_linenumber, l_returnflag""",
    "sizes": """
SELECT d.name AS database_name, s.name AS schema_name, t.name AS object_name, i.name AS index_name, i.index_id,
       p."rows", a.total_pages, a.used_pages, p.partition_id
FROM objs t JOIN idx i ON t.object_id = i.object_id
JOIN parts p ON i.object_id = p.object_id AND i.index_id = p.index_id
JOIN units a ON p.partition_id = a.container_id
LEFT JOIN schems s ON t.schema_id = s.schema_id
LEFT JOIN dbs d ON d.database_id = t.database_id
WHERE NOT t.is_ms_shipped""",
    "usage_": """
SELECT s_nationkey AS database_id, l_suppkey AS object_id, l_linenumber - 1 AS index_id,
       CAST(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS BIGINT) AS user_seeks,
       CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS user_scans,
       CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS user_lookups,
       count(*) AS user_updates
FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3""",
    "tran_locks": """
SELECT CASE l_linenumber WHEN 1 THEN 'OBJECT' WHEN 2 THEN 'PAGE' WHEN 3 THEN 'EXTENT' WHEN 4 THEN 'KEY'
            WHEN 5 THEN 'RID' WHEN 6 THEN 'HOBT' ELSE 'METADATA' END AS resource_type,
       CAST(l_linenumber AS VARCHAR) AS resource_description, l_partkey AS entity_id, p_size AS db_id,
       'LOCK' AS request_type,
       CASE WHEN l_linestatus = 'F' THEN 'GRANT' WHEN l_returnflag = 'N' THEN 'CONVERT' ELSE 'WAIT' END
         AS request_status,
       CASE l_returnflag WHEN 'A' THEN 'S' WHEN 'N' THEN 'IX' ELSE 'X' END AS request_mode,
       o_custkey AS session_id
FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey""",
    "requests": """
SELECT c.c_custkey AS session_id, b.blocker AS blocking_session_id,
       CASE WHEN c.c_acctbal >= 2000 THEN c.c_nationkey % 7 END AS transaction_isolation_level
FROM customer c LEFT JOIN (
  SELECT w.o_custkey AS session_id, min(h.o_custkey) AS blocker
  FROM (SELECT DISTINCT l_partkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_linestatus <> 'F') w
  JOIN (SELECT DISTINCT l_partkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey
        WHERE l_linestatus = 'F') h
    ON w.l_partkey = h.l_partkey AND w.l_linenumber = h.l_linenumber AND h.o_custkey < w.o_custkey
  GROUP BY 1) b ON b.session_id = c.c_custkey
WHERE c.c_acctbal >= 0""",
    "object_names": "SELECT p_partkey AS object_id, p_size AS db_id, p_brand AS name FROM part WHERE p_type <> 'PROMO'",
    "all_locks": """
SELECT CASE WHEN l.db_id < 50 THEN 'db_' || CAST(l.db_id AS VARCHAR) ELSE 'NULL' END AS db_name,
       l.resource_type, l.resource_description, l.entity_id AS hobt_id,
       CASE WHEN l.resource_type = 'METADATA' THEN l.resource_type ELSE o.name END AS object_name,
       l.request_type, l.request_status, l.request_mode, l.session_id, s.c_name AS login_name,
       s.c_mktsegment AS host_name, CASE WHEN s.c_acctbal < 3000 THEN 'sleeping' ELSE 'running' END AS status,
       s.c_nationkey % 4 AS open_transaction_count, r.blocking_session_id,
       coalesce(r.transaction_isolation_level, s.c_nationkey % 7) AS transaction_il, x.text,
       l.db_id, s.c_acctbal < -500 AS is_system
FROM tran_locks l JOIN customer s ON s.c_custkey = l.session_id
LEFT JOIN requests r ON r.session_id = s.c_custkey
LEFT JOIN texts x ON x.sql_handle = s.c_nationkey AND s.c_mktsegment <> 'MACHINERY'
LEFT JOIN object_names o ON o.db_id = l.db_id AND o.object_id = l.entity_id""",
    "snap": """
SELECT * EXCLUDE (db_id, is_system) REPLACE (coalesce(object_name,
         CASE WHEN resource_type = 'OBJECT' THEN 'OBJECT: ' ELSE 'HOBT: ' END || CAST(hobt_id AS VARCHAR)) AS object_name)
FROM all_locks WHERE db_id > 4 AND NOT is_system""",
    "pairs_resource": """
SELECT {pairs} FROM snap g JOIN snap w ON g.db_name = w.db_name AND g.hobt_id = w.hobt_id
 AND g.object_name = w.object_name AND g.resource_description = w.resource_description
 AND g.session_id <> w.session_id AND g.request_status = 'GRANT' AND w.request_status <> 'GRANT'""",
    "pairs": """
SELECT {pairs} FROM snap g JOIN snap w ON g.session_id = w.blocking_session_id AND g.db_name = w.db_name
 AND g.hobt_id = w.hobt_id AND g.object_name = w.object_name
 AND g.resource_description = w.resource_description AND g.session_id <> w.session_id""",
    "tasks": """
SELECT md5(CAST(o_orderkey AS VARCHAR)) AS uuid, o_orderkey AS task_id, CAST(o_orderkey % 10 AS INTEGER) AS stage,
       o_orderdate AS valid_to FROM orders""",
    "sample_keys": """
SELECT * FROM tasks ORDER BY md5('0:' || uuid), uuid LIMIT 150""",
    "sequence_": """
SELECT CAST(o_orderkey AS INTEGER) AS i, o_orderdate AS d, CAST(o_orderkey AS VARCHAR) AS v FROM orders""",
    "work_catalog": """
SELECT c_custkey AS database_id, c_name AS name,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 'OFFLINE' ELSE 'ONLINE' END AS state_desc FROM customer""",
    "work_ledger": """
SELECT c_name AS "dbName", CAST(NULL AS VARCHAR) AS restore_command, 0 AS processed,
       CAST(NULL AS TIMESTAMP) AS creation_dt, min(o_orderdate) AS start_dt, min(o_orderdate) AS finish_dt,
       CAST(NULL AS VARCHAR) AS error_msg
FROM orders JOIN customer ON c_custkey = o_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 400000 GROUP BY c_name""",
    "ledger": """
SELECT CAST(o_orderkey AS VARCHAR) AS "dbName", 'restore ' || CAST(o_orderkey AS VARCHAR) AS restore_command,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS processed, o_orderdate AS start_dt,
       CAST(NULL AS TIMESTAMP) AS finish_dt, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS error_msg
FROM orders""",
    "job_events": """
SELECT CAST(l_orderkey AS VARCHAR) AS "dbName", l_shipdate AS event_dt, l_returnflag AS flag,
       'step ' || CAST(l_linenumber AS VARCHAR) AS message FROM lineitem""",
}


def _half_up(num: str, den: str, scale: int, precision: int = 18) -> str:
    """num / den rounded half away from zero, on whole numbers, as a decimal."""
    unit = 10**scale
    n, d = f"abs({num})", f"nullif(abs({den}), 0)"
    rounded = f"(CAST(2 * {unit} AS HUGEINT) * {n} + {d}) // (2 * {d})"
    sign = f"CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END"
    step = f"CAST({1 / unit:.{scale}f} AS DECIMAL({scale + 1},{scale}))"
    return f"CAST(CAST({rounded} * {sign} AS DECIMAL(18,0)) * {step} AS DECIMAL({precision},{scale}))"


_PAIRS = """g.db_name, g.resource_type, g.object_name AS locked_object_name, g.resource_description AS resource,
 g.request_mode AS lock_mode, g.request_status AS lock_status, g.session_id AS "granted_SPID",
 g.login_name AS login, g.host_name AS host, g.text AS locking_query, g.status AS locking_session_status,
 g.open_transaction_count AS tran_cnt, w.request_mode AS waiting_lock_mode, w.session_id AS "waiting_SPID",
 w.login_name AS waiting_login, w.host_name AS waiting_host, w.blocking_session_id AS waiter_blocking_session,
 w.text AS waiting_query, w.open_transaction_count AS waiter_tran_cnt"""

RELATIONS["pairs_resource"] = RELATIONS["pairs_resource"].format(pairs=_PAIRS)
RELATIONS["pairs"] = RELATIONS["pairs"].format(pairs=_PAIRS)
RELATIONS["stats"] = RELATIONS["stats"].format(
    total_mb=_half_up("CAST(sum(total_grant_kb) AS BIGINT)", "1024", 4),
    min_mb=_half_up("min(min_grant_kb)", "1024", 4),
    max_mb=_half_up("max(max_grant_kb)", "1024", 4),
)


def _names(text: str) -> list[str]:
    return [n for n in RELATIONS if re.search(rf"\b{n}\b", text)]


def _sql(body: str) -> str:
    """The body with the relations it needs, directly or through others, in front of it."""
    needed: set[str] = set()
    todo = _names(body)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [n for n in _names(RELATIONS[name]) if n != name]
    ctes = ",\n".join(f"{n} AS ({RELATIONS[n]})" for n in RELATIONS if n in needed)
    recursive = "RECURSIVE " if "chain_walk" in body else ""
    if not ctes:
        return body
    if body.lstrip().startswith("WITH "):
        return f"WITH {recursive}{ctes},\n{body.lstrip()[5:]}"
    return f"WITH {recursive}{ctes}\n{body}"


# --------------------------------------------------------------------------------------------- queries

_WAIT_REPORT = f"""
SELECT wait_type, wait_count, {_half_up("wait_time_ms", "wait_count", 2)} AS avg_wait_time_ms,
       {_half_up("wait_time_ms", "1000", 4)} AS "wait_time_S",
       {_half_up("(wait_time_ms - signal_wait_time_ms)", "1000", 4)} AS "resource_wait_time_S",
       {_half_up("signal_wait_time_ms", "1000", 4)} AS "signal_wait_time_S"
FROM deltas ORDER BY {{order}} DESC, wait_type"""

_SIZE_MB = _half_up("size_on_disk_bytes", "1048576", 2)


def _io_delta(null_zero_stall: bool) -> str:
    rs, ws = ("nullif(rs, 0)", "nullif(ws, 0)") if null_zero_stall else ("rs", "ws")
    return f"""
SELECT name, file_id, type_desc, {_SIZE_MB} AS file_size_mb, r AS reads, {_half_up("rb", "1024", 2)} AS kbytes_read,
       {_half_up("rb", "(r * 1024)", 2)} AS kb_per_read, {_half_up(rs, "r", 3)} AS read_latency_ms, w AS writes,
       {_half_up("wb", "1024", 2)} AS kbytes_written, {_half_up("wb", "(w * 1024)", 2)} AS kb_per_write,
       {_half_up(ws, "w", 3)} AS write_latency_ms, {_half_up("(r + w)", "st", 3)} AS avg_latency_ms,
       {_half_up("st", "(r + w)", 3)} AS stall_ms_per_op
FROM io_change"""


def _sizes(groups: str, columns: str, condition: str = "true") -> str:
    total = 'CAST(sum(total_pages) * 8 AS BIGINT)'
    used = 'CAST(sum(used_pages) * 8 AS BIGINT)'
    return f"""
SELECT {columns} schema_name || '.' || object_name AS table_name, {"index_name," if "index_name" in groups else ""}
       "rows", {_half_up(total, '"rows"', 2, 36)} AS "avg_KB_per_row", {_half_up(total, "1024", 2, 36)} AS "total_MB",
       {_half_up(used, "1024", 2, 36)} AS "used_MB"
FROM sizes WHERE {condition} GROUP BY {groups}"""


_DETAIL = """
WITH contended AS (SELECT DISTINCT {party} AS session_id, locked_object_name, resource_type, resource FROM pairs
  WHERE {party} {belongs} (SELECT {other} FROM pairs))
SELECT s.session_id, s.login_name, s.host_name, s.status, s.db_name,
       if((s.object_name, s.resource_type, s.resource_description) = (c.locked_object_name, c.resource_type, c.resource),
          '___' || s.object_name || '___', s.object_name) AS object_name,
       s.resource_type, s.resource_description, s.hobt_id, s.request_type, {status} AS request_status, s.request_mode,
       s.open_transaction_count, s.text {blocker}
FROM snap s JOIN contended c USING (session_id)"""

_ROLES = """
WITH held_in AS (SELECT DISTINCT "granted_SPID" AS session_id, locked_object_name, resource_type, resource FROM {pairs}),
awaited_in AS (SELECT DISTINCT "waiting_SPID" AS session_id, locked_object_name, resource_type, resource FROM {pairs}),
roles AS (SELECT session_id, CASE WHEN NOT bool_or(waits) THEN 'head' WHEN bool_or(NOT waits) THEN 'mid' ELSE 'leaf' END AS role
  FROM (SELECT session_id, false AS waits FROM held_in UNION ALL SELECT session_id, true FROM awaited_in) GROUP BY 1),
flagged AS (SELECT s.*, r.role, CASE r.role
    WHEN 'leaf' THEN EXISTS (SELECT 1 FROM awaited_in h WHERE h.session_id = s.session_id AND h.locked_object_name = s.object_name
                             AND h.resource_type = s.resource_type AND h.resource = s.resource_description)
    ELSE EXISTS (SELECT 1 FROM held_in h WHERE h.session_id = s.session_id AND h.locked_object_name = s.object_name
                 AND h.resource_type = s.resource_type AND h.resource = s.resource_description) END AS hit
  FROM snap s JOIN roles r USING (session_id))
SELECT session_id, login_name, host_name, status, db_name, if(hit, '___' || object_name || '___', object_name) AS object_name,
       resource_type, resource_description, hobt_id, request_type,
       if(role = 'head' OR request_status = 'GRANT', request_status, '___' || request_status || '___') AS request_status,
       request_mode, open_transaction_count, text, blocking_session_id, role FROM flagged"""

_WAITING_STATUS = "if(s.request_status = 'GRANT', 'GRANT', '___' || s.request_status || '___')"


_DIAGNOSIS = f"if(plan_handle = other_plan, '{SINGLE_PLAN}', '{DRILL_DOWN}' || CAST(query_hash AS VARCHAR))"


def _percent(part: str, whole: str) -> str:
    return _half_up(f"({part} * 100)", whole, 2)


_SESSION_GROUP = (
    "session_id, login_name, host_name, status, blocking_session_id, transaction_il, text, open_transaction_count"
)

ORACLE = {
    "active_waits": "SELECT * FROM active_after",
    "tagged_snapshots": """
SELECT *, 1 AS snapshot_id FROM waits_before UNION ALL SELECT *, 10 AS snapshot_id FROM waits_after""",
    "stored_snapshot": "SELECT *, 10 AS snapshot_id FROM waits_after",
    "reused_snapshot": "SELECT * FROM work_catalog",
    "fan_out": "SELECT uuid, task_id, stage AS first_stage, valid_to, stage FROM tasks",
    "wait_delta": "SELECT * FROM deltas",
    "wait_report_wait_time": _WAIT_REPORT.format(order="wait_time_ms"),
    "wait_report_avg_wait": _WAIT_REPORT.format(order="wait_time_ms * 1.0 / wait_count"),
    "wait_report_wait_count": _WAIT_REPORT.format(order="wait_count"),
    "io_snapshot": f"""
SELECT name, file_id, type_desc, {_SIZE_MB} AS file_size_mb, num_of_reads, num_of_bytes_read, io_stall_read_ms,
       num_of_writes, num_of_bytes_written, io_stall_write_ms, io_stall FROM io_after""",
    "io_delta": _io_delta(False),
    "io_delta_null_stall": _io_delta(True),
    "health_report_waits": _WAIT_REPORT.format(order="wait_time_ms"),
    "health_report_files": _io_delta(False),
    "counter_history_delta": """
SELECT * FROM (
  SELECT wait_type, lag(captured_at) OVER w AS from_time, captured_at,
         wait_time_ms - lag(wait_time_ms) OVER w AS wait_time_ms_delta,
         waiting_tasks_count - lag(waiting_tasks_count) OVER w AS waiting_tasks_count_delta
  FROM wait_history WINDOW w AS (PARTITION BY wait_type ORDER BY captured_at))
WHERE from_time IS NOT NULL""",
    "delta_stream": """
SELECT * FROM (
  SELECT wait_type, lag(captured_at) OVER w AS from_time, captured_at, ms - lag(ms) OVER w AS wait_time_ms_delta
  FROM (SELECT event_type || '#' || CAST(user_id AS VARCHAR) AS wait_type, date_trunc('second', ts) AS captured_at,
               CAST(floor(value * 1000) AS BIGINT) AS ms FROM events)
  WINDOW w AS (PARTITION BY wait_type ORDER BY captured_at, ms))
WHERE from_time IS NOT NULL""",
    "query_rollup": "SELECT * FROM stats",
    "plan_divergence": f"""
SELECT query_hash, sql_handle, plan_handle <> other_plan AS has_other_plans, {_DIAGNOSIS} AS diagnosis_query FROM stats""",
    "top_queries": f"""
SELECT d.name AS database_name, t.text AS query_text, p.query_plan, s.execution_count,
       (total_worker_time - max_worker_time - min_worker_time) // 1000 // nullif(execution_count - 2, 0) AS avg_time_ms,
       min_worker_time // 1000 AS min_time_ms, max_worker_time // 1000 AS max_time_ms,
       total_worker_time // 1000 AS total_time_ms,
       (total_logical_reads - min_logical_reads - max_logical_reads) // nullif(execution_count - 2, 0)
         AS avg_logical_reads,
       min_logical_reads, max_logical_reads, total_logical_reads,
       {_half_up("CAST(total_grant_MB * 10000 AS BIGINT)", "(execution_count * 10000)", 4)} AS "avg_grant_MB",
       min_grant_MB, max_grant_MB, total_spills, {_DIAGNOSIS.replace("(plan_handle =", "(s.plan_handle =")} AS diagnosis_query
FROM stats s LEFT JOIN texts t ON t.sql_handle = s.sql_handle LEFT JOIN plans p ON p.plan_handle = s.plan_handle
LEFT JOIN dbs d ON d.database_id = coalesce(t.dbid, p.dbid)
ORDER BY execution_count DESC, query_hash, s.sql_handle LIMIT 100""",
    "plans_for_query": """
SELECT query_hash, t.text, p.query_plan, execution_count, total_worker_time // 1000 AS total_worker_time,
       total_logical_reads, total_grant_kb // 1024 AS "total_grant_MB", total_spills
FROM query_stats s LEFT JOIN texts t ON t.sql_handle = s.sql_handle
LEFT JOIN plans p ON p.plan_handle = s.plan_handle""",
    "index_usage": """
SELECT s.name || '.' || o.name AS table_name, i.name AS index_name, user_seeks, user_scans, user_lookups, user_updates
FROM usage_ u JOIN idx i ON u.index_id = i.index_id AND u.object_id = i.object_id
JOIN objs o ON i.object_id = o.object_id AND o.database_id = u.database_id JOIN schems s ON o.schema_id = s.schema_id""",
    "object_sizes": _sizes('schema_name, object_name, "rows"', ""),
    "object_sizes_by_index": _sizes('schema_name, object_name, "rows", index_name', ""),
    "object_sizes_rolled_up": f"""
SELECT schema_name || '.' || object_name AS table_name, CAST(n AS BIGINT) AS "rows",
       {_half_up("kb", "n", 2, 36)} AS "avg_KB_per_row", {_half_up("kb", "1024", 2, 36)} AS "total_MB",
       {_half_up("used", "1024", 2, 36)} AS "used_MB"
FROM (SELECT schema_name, object_name, CAST(sum(kb) AS BIGINT) AS kb, CAST(sum(used) AS BIGINT) AS used,
             CAST(sum(CASE WHEN index_id <= 1 THEN "rows" ELSE 0 END) AS BIGINT) AS n
      FROM (SELECT schema_name, object_name, index_id, partition_id, "rows", sum(total_pages) * 8 AS kb,
                   sum(used_pages) * 8 AS used FROM sizes GROUP BY ALL) GROUP BY 1, 2)""",
    "object_sizes_all": _sizes(
        'database_name, schema_name, object_name, "rows"',
        "database_name,",
        "database_name IN (SELECT name FROM dbs WHERE database_id > 4)",
    ),
    "object_sizes_named": _sizes(
        'database_name, schema_name, object_name, "rows", index_name',
        "database_name,",
        "database_name IN ('NATION_1', 'NATION_7', 'NATION_12')",
    ),
    "placement_drift": """
SELECT object_id, index_id, i.name AS index_name, is_unique, g.name AS filegroup_name
FROM idx i JOIN groups_ g ON i.data_space_id = g.data_space_id WHERE index_id IN (0, 1) AND g.name <> 'AFRICA'""",
    "secondary_indexes": "SELECT * FROM idx WHERE index_id > 1 AND NOT is_disabled",
    "join_children": """
SELECT database_id, string_agg(physical_name, ', ' ORDER BY file_id) AS files FROM files GROUP BY 1""",
    "collation_scripts": """
SELECT d.name AS "dbName", 'ALTER DATABASE ' || d.name || ' SET OFFLINE WITH ROLLBACK IMMEDIATE;' AS offline_script,
       'CREATE DATABASE [' || replace(d.name, ']', ']]') || '] ON ' || f.list || ' FOR ATTACH;' AS attach_script,
       'exec sp_detach_db @dbname = ''' || d.name || ''', @skipchecks = ''true'';' AS detach_script
FROM dbs d LEFT JOIN (SELECT database_id, string_agg('(FILENAME = N''' || physical_name || ''')', ', ' ORDER BY file_id)
                      AS list FROM files GROUP BY 1) f ON f.database_id = d.database_id
WHERE d.database_id > 4""",
    "move_commands": r"""
SELECT d.name AS "dbName",
       'BACKUP DATABASE [' || d.name || '] TO DISK = ''\\vault\nightly\' || d.name
         || '.bak'' WITH INIT, STATS = 5;' AS backup_command,
       'ALTER DATABASE [' || d.name || '] SET OFFLINE WITH ROLLBACK IMMEDIATE;' AS offline_command,
       'RESTORE DATABASE [' || d.name || '] FROM DISK = ''F:\restore\' || d.name || '.bak'' WITH ' || f.list
         || 'REPLACE, RECOVERY, STATS = 5;' AS restore_command
FROM dbs d LEFT JOIN (
  SELECT database_id, string_agg('MOVE ''' || name || ''' TO ''G:\files\' || name || '.mdf'', ', ''
                                 ORDER BY file_id) AS list FROM files GROUP BY 1) f ON f.database_id = d.database_id""",
    "pending_work": """
SELECT * FROM work_catalog WHERE database_id > 4 AND state_desc = 'ONLINE' AND name <> 'Customer#000000009'
 AND name NOT IN (SELECT "dbName" FROM work_ledger)""",
    "extend_ledger": """
SELECT * FROM work_ledger UNION ALL
SELECT name, 'restore ' || name, NULL, TIMESTAMP '2000-01-01', NULL, NULL, NULL FROM work_catalog
WHERE database_id > 4 AND state_desc = 'ONLINE' AND name NOT IN (SELECT "dbName" FROM work_ledger)""",
    "ledger_apply": """
WITH outcome AS (SELECT "dbName", event_dt, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS code,
    row_number() OVER (PARTITION BY "dbName" ORDER BY event_dt DESC, flag DESC) AS rn
  FROM job_events WHERE flag IN ('A', 'R')),
failure AS (SELECT "dbName", message, row_number() OVER (PARTITION BY "dbName" ORDER BY event_dt DESC, message DESC) AS rn
  FROM job_events WHERE flag = 'R'),
started AS (SELECT "dbName", max(event_dt) AS at FROM job_events WHERE flag = 'N' GROUP BY 1)
SELECT l."dbName", l.restore_command, coalesce(o.code, l.processed) AS processed, coalesce(s.at, l.start_dt) AS start_dt,
       coalesce(o.event_dt, l.finish_dt) AS finish_dt, coalesce(f.message, l.error_msg) AS error_msg
FROM ledger l LEFT JOIN outcome o ON o."dbName" = l."dbName" AND o.rn = 1
LEFT JOIN failure f ON f."dbName" = l."dbName" AND f.rn = 1 LEFT JOIN started s ON s."dbName" = l."dbName\"""",
    "ledger_apply_strict": """
WITH spread AS (SELECT event_dt, message FROM job_events WHERE flag = 'R' ORDER BY event_dt DESC, message DESC LIMIT 1),
success AS (SELECT "dbName", max(event_dt) AS at FROM job_events WHERE flag = 'A' GROUP BY 1),
started AS (SELECT "dbName", max(event_dt) AS at FROM job_events WHERE flag = 'N' GROUP BY 1)
SELECT l."dbName", l.restore_command, CASE WHEN a.at > p.event_dt THEN 0 ELSE 1 END AS processed,
       coalesce(s.at, l.start_dt) AS start_dt, greatest(a.at, p.event_dt) AS finish_dt, p.message AS error_msg
FROM ledger l CROSS JOIN spread p LEFT JOIN success a ON a."dbName" = l."dbName"
LEFT JOIN started s ON s."dbName" = l."dbName\"""",
    "ledger_report": f"""
SELECT "dbName", CASE processed WHEN 1 THEN '{STATUS_TEXTS[1]}' WHEN 0 THEN '{STATUS_TEXTS[0]}'
       ELSE '{STATUS_TEXTS[None]}' END AS "Status", start_dt, finish_dt, error_msg FROM ledger""",
    "next_pending": """
SELECT "dbName", restore_command FROM ledger WHERE processed IS NULL ORDER BY "dbName" LIMIT 1""",
    "lock_snapshot": "SELECT * FROM snap",
    "lock_snapshot_strict": "SELECT * EXCLUDE (db_id, is_system) FROM all_locks WHERE db_id > 0",
    "wait_pairs_resource": "SELECT * FROM pairs_resource",
    "wait_pairs_blocker": "SELECT * FROM pairs",
    "wait_pair_report": 'SELECT * FROM pairs WHERE waiter_blocking_session = "granted_SPID"',
    "holders_by_resource": """
SELECT DISTINCT "granted_SPID" AS session_id, locked_object_name, resource_type, resource FROM pairs_resource""",
    "waiters_by_resource": """
SELECT DISTINCT "waiting_SPID" AS session_id, locked_object_name, resource_type, resource FROM pairs_resource""",
    "session_overview": f"""
WITH marked AS (SELECT *, request_status = 'GRANT' AS held, request_status <> 'GRANT' AS awaited,
    resource_type = 'OBJECT' AND NOT starts_with(request_mode, 'I') AS plain FROM snap),
tally AS (SELECT {_SESSION_GROUP}, count(DISTINCT db_name) AS locks_in_dbs,
    count(*) FILTER (held) AS granted_locks, count(*) FILTER (awaited) AS waiting_locks,
    count(DISTINCT object_name) FILTER (held) AS objects_with_granted_locks,
    count(DISTINCT object_name) FILTER (awaited) AS objects_with_waiting_locks,
    count(DISTINCT object_name) FILTER (held AND plain) AS nonintent_objects_granted_locks
  FROM marked GROUP BY ALL),
levels(code, isolation_level) AS (VALUES (0, 'Unspecified'), (1, 'Read Uncommitted'), (2, 'Read Committed'),
  (3, 'Repeatable Read'), (4, 'Serializable'), (5, 'Snapshot')),
blocking AS (SELECT DISTINCT "granted_SPID" AS session_id FROM pairs),
versioned AS (SELECT c_custkey AS session_id FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT t.session_id, login_name, host_name, if(granted_locks > 0 AND status = 'sleeping', 'SLEEPING', status) AS status,
       open_transaction_count,
       CASE WHEN transaction_il = 2 AND v.session_id IS NOT NULL THEN 'Read Committed Snapshot'
            ELSE coalesce(isolation_level, 'UNKNOWN') END AS isolation_level,
       text, locks_in_dbs, granted_locks, waiting_locks, objects_with_granted_locks, objects_with_waiting_locks,
       nonintent_objects_granted_locks, if(b.session_id IS NULL, '', 'V') AS blocker_mark
FROM tally t LEFT JOIN levels ON code = transaction_il LEFT JOIN blocking b ON b.session_id = t.session_id
LEFT JOIN versioned v ON v.session_id = t.session_id""",
    "object_overview": f"""
WITH marked AS (SELECT *, request_status = 'GRANT' AS held, request_status <> 'GRANT' AS awaited,
    resource_type = 'OBJECT' AS whole_object, resource_type IN ('KEY', 'RID') AS row_lock, resource_type = 'PAGE' AS page,
    NOT starts_with(request_mode, 'I') AS plain FROM snap),
tally AS (SELECT db_name, object_name, count(*) AS overall_locks, count(*) FILTER (held) AS granted_locks,
    count(DISTINCT session_id) FILTER (held) AS sessions_with_granted_locks,
    count(DISTINCT session_id) FILTER (awaited) AS waiting_sessions, count(*) FILTER (awaited) AS waiting_locks,
    count(*) FILTER (whole_object AND plain AND held) AS object_nonintent_locks_granted,
    count(*) FILTER (whole_object AND awaited) AS object_locks_waiting,
    count(*) FILTER (row_lock AND held) AS key_locks_granted, count(*) FILTER (row_lock AND awaited) AS key_locks_waiting,
    count(*) FILTER (page AND held) AS page_locks_granted, count(*) FILTER (page AND awaited) AS page_locks_waiting,
    count(*) FILTER (row_lock) AS key_locks
  FROM marked GROUP BY ALL),
whole_db AS (SELECT db_name, count(*) AS locks_in_db_overall FROM snap GROUP BY db_name)
SELECT t.* EXCLUDE (key_locks), {_percent("key_locks", "overall_locks")} AS key_locks_pctg, locks_in_db_overall,
       {_percent("overall_locks", "locks_in_db_overall")} AS tbl_locks_in_db_pctg
FROM tally t JOIN whole_db USING (db_name)""",
    "head_blockers": _DETAIL.format(
        party='"granted_SPID"', other='"waiting_SPID"', belongs="NOT IN", status="s.request_status", blocker=""
    ),
    "mid_blockers": _DETAIL.format(
        party='"granted_SPID"',
        other='"waiting_SPID"',
        belongs="IN",
        status=_WAITING_STATUS,
        blocker=", s.blocking_session_id",
    ),
    "leaf_waiters": _DETAIL.format(
        party='"waiting_SPID"',
        other='"granted_SPID"',
        belongs="NOT IN",
        status=_WAITING_STATUS,
        blocker=", s.blocking_session_id",
    ),
    "leaf_waiters_once": f"""
SELECT s.session_id, s.login_name, s.host_name, s.status, s.db_name,
       CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p."waiting_SPID" = s.session_id
                         AND p.locked_object_name = s.object_name AND p.resource_type = s.resource_type
                         AND p.resource = s.resource_description)
            THEN '___' || s.object_name || '___' ELSE s.object_name END AS object_name,
       s.resource_type, s.resource_description, s.hobt_id, s.request_type, {_WAITING_STATUS} AS request_status,
       s.request_mode, s.open_transaction_count, s.text, s.blocking_session_id
FROM snap s WHERE s.session_id IN (SELECT "waiting_SPID" FROM pairs)
 AND s.session_id NOT IN (SELECT "granted_SPID" FROM pairs)""",
    "blocking_chains_reference": """
WITH edges AS (SELECT DISTINCT session_id, blocking_session_id FROM snap)
SELECT c.session_id, min(coalesce(CAST(p.blocking_session_id AS VARCHAR) || ' -> ', '')
         || CAST(c.blocking_session_id AS VARCHAR)) || ' -> ' || CAST(c.session_id AS VARCHAR) AS blocking_chain
FROM edges c JOIN edges p ON c.blocking_session_id = p.session_id GROUP BY c.session_id""",
    "blocking_chains_full": """
WITH edges AS (SELECT DISTINCT session_id, nullif(blocking_session_id, 0) AS blocking_session_id FROM snap),
chain_walk AS (
  SELECT session_id, blocking_session_id AS next, CAST(session_id AS VARCHAR) AS chain, 1 AS n, session_id AS root
  FROM edges
  UNION ALL
  SELECT c.session_id, e.blocking_session_id, CAST(c.next AS VARCHAR) || ' -> ' || c.chain, c.n + 1, c.next
  FROM chain_walk c LEFT JOIN edges e ON e.session_id = c.next WHERE c.next IS NOT NULL)
SELECT session_id, chain AS blocking_chain, n AS chain_length, root AS root_session_id, false AS has_cycle
FROM chain_walk WHERE next IS NULL""",
    "session_locks": """
SELECT l.session_id, l.request_mode, l.request_status, o.name AS locked_object, l.resource_type, count(*) AS total_locks
FROM tran_locks l LEFT JOIN object_names o ON o.db_id = l.db_id AND o.object_id = l.entity_id
GROUP BY 1, 2, 3, 4, 5""",
    "blocked_by": """
SELECT blocking_session_id AS session_id, count(*) AS blocked_sessions_count, min(session_id) AS min_blocked_session_id
FROM requests WHERE blocking_session_id IS NOT NULL AND blocking_session_id <> 0 GROUP BY 1""",
    "lock_report": """
WITH blocked AS (SELECT blocking_session_id AS session_id, min(session_id) AS lowest FROM requests
  WHERE blocking_session_id <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
shown AS (SELECT session_id FROM blocked UNION ALL SELECT lowest FROM blocked)
SELECT l.session_id, l.request_mode, l.request_status, o.name AS locked_object, l.resource_type, count(*) AS total_locks
FROM shown JOIN tran_locks l USING (session_id)
LEFT JOIN object_names o ON o.db_id = l.db_id AND o.object_id = l.entity_id GROUP BY 1, 2, 3, 4, 5""",
    "locking_report": """
WITH edges AS (SELECT DISTINCT session_id, blocking_session_id FROM snap),
held AS (SELECT DISTINCT "granted_SPID" AS session_id, locked_object_name, resource_type, resource FROM pairs),
awaited AS (SELECT DISTINCT "waiting_SPID" AS session_id, locked_object_name, resource_type, resource FROM pairs)
SELECT 'snapshot' AS section, (SELECT count(*) FROM snap) AS "rows"
UNION ALL SELECT 'wait_pairs', (SELECT count(*) FROM pairs)
UNION ALL SELECT 'sessions', (SELECT count(*) FROM (SELECT DISTINCT session_id FROM snap))
UNION ALL SELECT 'objects', (SELECT count(*) FROM (SELECT DISTINCT db_name, object_name FROM snap))
UNION ALL SELECT 'head_blockers', (SELECT count(*) FROM snap JOIN held USING (session_id)
                                   WHERE session_id NOT IN (SELECT session_id FROM awaited))
UNION ALL SELECT 'mid_blockers', (SELECT count(*) FROM snap JOIN held USING (session_id)
                                  WHERE session_id IN (SELECT session_id FROM awaited))
UNION ALL SELECT 'leaf_waiters', (SELECT count(*) FROM snap JOIN awaited USING (session_id)
                                  WHERE session_id NOT IN (SELECT session_id FROM held))
UNION ALL SELECT 'blocking_chains', (SELECT count(DISTINCT c.session_id) FROM edges c
                                     JOIN edges p ON p.session_id = c.blocking_session_id)""",
    "generate_tasks": """
SELECT n AS task_id, CAST(n % 10 AS INTEGER) AS stage, '2000-01-01 00:00:00' AS valid_to
FROM (SELECT row_number() OVER () AS n FROM orders)""",
    "generate_sequence": """
SELECT CAST(n AS INTEGER) AS i, TIMESTAMP '2020-01-01' + to_seconds(n) AS d, CAST(n AS VARCHAR) AS v
FROM (SELECT row_number() OVER () AS n FROM lineitem)""",
    "sample_exact": "SELECT * FROM sample_keys",
    "update_where_in": """
SELECT uuid, task_id, CASE WHEN uuid IN (SELECT uuid FROM sample_keys) THEN stage + 1 ELSE stage END AS stage, valid_to
FROM tasks""",
    "update_all": "SELECT uuid, task_id, stage, valid_to + to_seconds(task_id) AS valid_to FROM tasks",
    "delete_where": "SELECT * FROM tasks WHERE valid_to < TIMESTAMP '2000-01-01' + to_seconds(8192)",
    "repeat_update": """
WITH drawn AS (SELECT uuid, row_number() OVER (PARTITION BY r ORDER BY md5(CAST(r AS VARCHAR) || ':' || uuid), uuid) AS rn
  FROM tasks, generate_series(1, 50) AS g(r)),
hits AS (SELECT uuid, count(*) AS n FROM drawn WHERE rn <= 75 GROUP BY 1)
SELECT t.uuid, t.task_id, CAST(t.stage + coalesce(h.n, 0) AS INTEGER) AS stage, t.valid_to
FROM tasks t LEFT JOIN hits h ON h.uuid = t.uuid""",
    "with_defaults": """
SELECT task_id, stage, 36 AS key_length, '2000-01-01 00:00:00' AS valid_to FROM tasks""",
    "top_k": "SELECT * FROM sequence_ ORDER BY d, i LIMIT 1000",
    "top_k_by_key": "SELECT * FROM sequence_ ORDER BY i LIMIT 10000",
    "fixed_width": "SELECT i, d, rpad(v, 7, ' ') AS v FROM sequence_",
    "top_k_fixed_width": "SELECT i, d, rpad(v, 7, ' ') AS v FROM sequence_ ORDER BY d, i LIMIT 1000",
}

_CLASS = """
SELECT g.db_name, g.hobt_id, g.object_name AS locked_object_name, g.resource_description AS resource, g.resource_type,
       g.request_mode AS lock_mode, g.request_status AS lock_status, {link} w.request_mode AS waiting_lock_mode, {holders} AS holders,
       {waiters} AS waiters, count(*) AS pairs
FROM (SELECT row_number() OVER () AS n, * FROM snap) g JOIN (SELECT row_number() OVER () AS n, * FROM snap) w
  ON g.db_name = w.db_name AND g.hobt_id = w.hobt_id AND g.object_name = w.object_name
 AND g.resource_description = w.resource_description AND g.session_id <> w.session_id AND {met}
GROUP BY g.db_name, g.hobt_id, g.object_name, g.resource_description, g.resource_type, g.request_mode, g.request_status, {group} w.request_mode"""

# rows of the classes, whether or not each is in a pair
_HOLDERS = """(SELECT count(*) FROM snap h WHERE h.db_name = g.db_name AND h.hobt_id = g.hobt_id AND h.object_name = g.object_name
  AND h.resource_description = g.resource_description AND h.resource_type = g.resource_type AND h.request_mode = g.request_mode
  AND h.request_status = g.request_status)"""
_WAITERS = """(SELECT count(*) FROM snap h WHERE h.db_name = g.db_name AND h.hobt_id = g.hobt_id AND h.object_name = g.object_name
  AND h.resource_description = g.resource_description AND h.request_mode = w.request_mode AND h.request_status <> 'GRANT')"""

# with system databases and sessions, names as in the plain snapshot
_ALL_SHOT = """
SELECT * EXCLUDE (db_id, is_system) REPLACE (coalesce(object_name,
         CASE WHEN resource_type = 'OBJECT' THEN 'OBJECT: ' ELSE 'HOBT: ' END || CAST(hobt_id AS VARCHAR)) AS object_name)
FROM all_locks WHERE db_id > 0"""
_LOGIN = "Customer#000000010"

_SINK = """
WITH captures AS (SELECT 'user#' || CAST(user_id AS VARCHAR) AS wait_type, ts AS captured_at, event_type = 'view' AS second,
    CASE WHEN value >= 20 THEN CAST(floor(value * 1000) AS BIGINT) END AS wait_time_ms FROM events),
marks AS (SELECT max(captured_at) FILTER (NOT second) - INTERVAL {delay} AS m0, max(captured_at) - INTERVAL {delay} AS m1 FROM captures),
placed AS (SELECT c.* FROM captures c, marks WHERE captured_at <= m1 AND (NOT second OR captured_at > m0))"""
_SINK_DELTAS = f"""{_SINK}
SELECT * FROM (
  SELECT wait_type, lag(captured_at) OVER w AS from_time, captured_at, wait_time_ms - lag(wait_time_ms) OVER w AS wait_time_ms_delta
  FROM placed WINDOW w AS (PARTITION BY wait_type ORDER BY captured_at, wait_time_ms NULLS FIRST))
WHERE from_time IS NOT NULL"""

_WALK = """
WITH RECURSIVE most AS (SELECT max(c_custkey) AS n FROM customer),
links AS (SELECT c_custkey AS session_id,
    CASE WHEN c_mktsegment <> 'MACHINERY' THEN (c_custkey * 7919 + c_nationkey * 104729) % n + 1 END AS blocker, c_acctbal FROM customer, most),
chain_walk AS (
  SELECT session_id, blocker AS onward, [session_id] AS path FROM links
  UNION ALL
  SELECT w.session_id, l.blocker, list_append(w.path, w.onward) FROM chain_walk w JOIN links l ON l.session_id = w.onward
  WHERE NOT list_contains(w.path, w.onward)),
walked AS (SELECT * FROM chain_walk WHERE onward IS NULL OR list_contains(path, onward))"""

_FLEET_WAITS = """
SELECT * FROM (
  SELECT 'srv' || CAST(user_id % 7 AS VARCHAR) AS server_id, date_trunc('day', ts) AS captured_at, event_type AS wait_type,
         CAST(sum(CAST(floor(value * 1000) AS BIGINT)) AS BIGINT) AS t, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS s, count(*) AS n
  FROM events WHERE {period} GROUP BY 1, 2, 3)
QUALIFY captured_at = max(captured_at) OVER (PARTITION BY server_id, wait_type)"""
_FLEET_SNAP = "fleet_snap AS (SELECT *, if(hobt_id % 2 = 0, 'even', 'odd') AS server_id FROM snap)"
_FLEET_PAIRS = """fleet_pairs AS (SELECT g.server_id, g.session_id AS holder, w.session_id AS waiter, g.object_name, g.resource_type, g.resource_description
  FROM fleet_snap g JOIN fleet_snap w ON g.server_id = w.server_id AND g.session_id = w.blocking_session_id AND g.db_name = w.db_name
   AND g.hobt_id = w.hobt_id AND g.object_name = w.object_name AND g.resource_description = w.resource_description AND g.session_id <> w.session_id)"""

_HISTORY_MODE = """
SELECT wait_type, from_time, captured_at, {ms} AS wait_time_ms_delta, {n} AS waiting_tasks_count_delta FROM (
  SELECT wait_type, lag(captured_at) OVER w AS from_time, captured_at, wait_time_ms - lag(wait_time_ms) OVER w AS ms,
         waiting_tasks_count - lag(waiting_tasks_count) OVER w AS n
  FROM wait_history WINDOW w AS (PARTITION BY wait_type ORDER BY captured_at))
WHERE from_time IS NOT NULL"""

ORACLE |= {
    "counter_history_delta_abs": _HISTORY_MODE.format(ms="abs(ms)", n="abs(n)"),
    "counter_history_delta_null": _HISTORY_MODE.format(ms="CASE WHEN ms >= 0 THEN ms END", n="CASE WHEN n >= 0 THEN n END"),
    "wait_delta_reset_null": """
SELECT wait_type, CASE WHEN NOT back THEN t END AS wait_time_ms, CASE WHEN NOT back THEN s END AS signal_wait_time_ms,
       CASE WHEN NOT back THEN n END AS wait_count
FROM (SELECT *, least(t, s, n) < 0 AS back FROM (
  SELECT wait_type, ifnull(b.wait_time_ms, 0) - ifnull(a.wait_time_ms, 0) AS t, ifnull(b.signal_wait_time_ms, 0) - ifnull(a.signal_wait_time_ms, 0) AS s,
         ifnull(b.waiting_tasks_count, 0) - ifnull(a.waiting_tasks_count, 0) AS n
  FROM active_before b FULL JOIN active_after a USING (wait_type)))
WHERE back OR n > 0""",
    "block_join_grid": """
SELECT c_nationkey AS nation, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey""",
    "wait_delta_fleet": f"""
WITH b AS ({_FLEET_WAITS.format(period="ts < TIMESTAMP '2024-01-15'")}), a AS ({_FLEET_WAITS.format(period="true")})
SELECT * FROM (SELECT server_id, wait_type, abs(ifnull(a.t, 0) - ifnull(b.t, 0)) AS wait_time_ms, abs(ifnull(a.s, 0) - ifnull(b.s, 0)) AS signal_wait_time_ms,
       abs(ifnull(a.n, 0) - ifnull(b.n, 0)) AS wait_count FROM b FULL JOIN a USING (server_id, wait_type)) WHERE wait_count > 0""",
    "query_rollup_fleet": """
SELECT l_returnflag AS server_id, CAST(date_trunc('year', l_shipdate) AS TIMESTAMP) AS captured_at, l_partkey AS query_hash, l_suppkey % 5 AS sql_handle,
       count(*) AS execution_count, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS total_worker_time,
       max(CAST(floor(l_extendedprice) AS BIGINT)) AS max_worker_time, min(CAST(floor(l_extendedprice) AS BIGINT)) AS min_worker_time,
       CAST(sum(CAST(floor(l_quantity) AS BIGINT)) AS BIGINT) AS total_logical_reads,
       max(CAST(l_linenumber AS BIGINT)) AS plan_handle, min(CAST(l_linenumber AS BIGINT)) AS other_plan
FROM lineitem GROUP BY ALL""",
    "index_usage_fleet": """
SELECT u.database_id, s.name || '.' || o.name AS table_name, i.name AS index_name, user_seeks, user_scans, user_lookups, user_updates
FROM usage_ u JOIN idx i ON u.index_id = i.index_id AND u.object_id = i.object_id
JOIN objs o ON i.object_id = o.object_id AND o.database_id = u.database_id JOIN schems s ON o.schema_id = s.schema_id""",
    "session_overview_fleet": f"""
WITH {_FLEET_SNAP}, {_FLEET_PAIRS},
tally AS (SELECT server_id, {_SESSION_GROUP}, count(DISTINCT db_name) AS locks_in_dbs,
    count(*) FILTER (request_status = 'GRANT') AS granted_locks, count(*) FILTER (request_status <> 'GRANT') AS waiting_locks,
    count(DISTINCT object_name) FILTER (request_status = 'GRANT') AS objects_with_granted_locks,
    count(DISTINCT object_name) FILTER (request_status <> 'GRANT') AS objects_with_waiting_locks,
    count(DISTINCT object_name) FILTER (request_status = 'GRANT' AND resource_type = 'OBJECT' AND NOT starts_with(request_mode, 'I'))
      AS nonintent_objects_granted_locks
  FROM fleet_snap GROUP BY ALL),
levels(code, isolation_level) AS (VALUES (0, 'Unspecified'), (1, 'Read Uncommitted'), (2, 'Read Committed'),
  (3, 'Repeatable Read'), (4, 'Serializable'), (5, 'Snapshot'))
SELECT t.server_id, t.session_id, login_name, host_name, if(granted_locks > 0 AND status = 'sleeping', 'SLEEPING', status) AS status,
       open_transaction_count,
       CASE WHEN transaction_il = 2 AND t.session_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'Read Committed Snapshot'
            ELSE coalesce(isolation_level, 'UNKNOWN') END AS isolation_level,
       text, locks_in_dbs, granted_locks, waiting_locks, objects_with_granted_locks, objects_with_waiting_locks, nonintent_objects_granted_locks,
       if(EXISTS (SELECT 1 FROM fleet_pairs p WHERE p.server_id = t.server_id AND p.holder = t.session_id), 'V', '') AS blocker_mark
FROM tally t LEFT JOIN levels ON code = transaction_il""",
    "lock_details_fleet": f"""
WITH {_FLEET_SNAP}, {_FLEET_PAIRS},
ends AS (SELECT DISTINCT server_id, holder AS session_id, false AS waits, object_name, resource_type, resource_description FROM fleet_pairs
  UNION SELECT DISTINCT server_id, waiter, true, object_name, resource_type, resource_description FROM fleet_pairs),
roles AS (SELECT server_id, session_id, CASE WHEN NOT bool_or(waits) THEN 'head' WHEN bool_or(NOT waits) THEN 'mid' ELSE 'leaf' END AS role
  FROM ends GROUP BY ALL),
flagged AS (SELECT s.*, r.role, EXISTS (SELECT 1 FROM ends e WHERE e.server_id = s.server_id AND e.session_id = s.session_id
    AND e.object_name = s.object_name AND e.resource_type = s.resource_type AND e.resource_description = s.resource_description
    AND e.waits = (r.role = 'leaf')) AS hit
  FROM fleet_snap s JOIN roles r USING (server_id, session_id))
SELECT server_id, session_id, login_name, host_name, status, db_name, if(hit, '___' || object_name || '___', object_name) AS object_name,
       resource_type, resource_description, hobt_id, request_type,
       if(role = 'head' OR request_status = 'GRANT', request_status, '___' || request_status || '___') AS request_status,
       request_mode, open_transaction_count, text, blocking_session_id, role FROM flagged""",
    "plans_for_one_query": """
SELECT query_hash, t.text, p.query_plan, execution_count, total_worker_time // 1000 AS total_worker_time,
       total_logical_reads, total_grant_kb // 1024 AS "total_grant_MB", total_spills
FROM query_stats s LEFT JOIN texts t ON t.sql_handle = s.sql_handle
LEFT JOIN plans p ON p.plan_handle = s.plan_handle WHERE query_hash = 7""",
    "plan_divergence_binary": f"""
SELECT sql_handle, plan_handle <> other_plan AS has_other_plans,
       if(plan_handle = other_plan, '{SINGLE_PLAN}', '{DRILL_DOWN}' || concat('X', chr(39), upper(md5(CAST(query_hash AS VARCHAR))), chr(39))) AS diagnosis_query FROM stats""",
    "with_defaults_now": "SELECT task_id, stage, 36 AS key_length, true AS is_recent FROM tasks",
    "chain_roots": """
WITH edges AS (SELECT DISTINCT session_id, nullif(blocking_session_id, 0) AS blocker FROM snap),
chain_walk AS (
  SELECT session_id, blocker AS onward, 1 AS n, session_id AS root FROM edges
  UNION ALL
  SELECT c.session_id, e.blocker, c.n + 1, c.onward FROM chain_walk c LEFT JOIN edges e ON e.session_id = c.onward WHERE c.onward IS NOT NULL)
SELECT c.session_id, e.blocker AS blocking_session_id, root AS root_session_id, CAST(n AS BIGINT) AS chain_length, CAST(NULL AS BIGINT) AS cycle_id
FROM chain_walk c JOIN edges e USING (session_id) WHERE onward IS NULL""",
    "chain_roots_circles": f"""{_WALK}
SELECT w.session_id, l.blocker AS blocking_session_id, w.path[-1] AS root_session_id, len(w.path) AS chain_length,
       list_min(CASE WHEN w.onward IS NOT NULL THEN list_slice(w.path, list_position(w.path, w.onward), len(w.path)) END) AS cycle_id
FROM walked w JOIN links l USING (session_id)""",
    "expand_chains": f"""{_WALK}
SELECT session_id, unnest(range(len(path))) AS step, unnest(path) AS on_path FROM walked JOIN links USING (session_id) WHERE c_acctbal > 9000""",
    "numbered_orders": """
SELECT o_custkey, o_orderdate, o_orderkey, o_totalprice, count(*) OVER (PARTITION BY o_custkey) AS group_rows,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1 AS position FROM orders""",
    "numbered_lines": """
SELECT l_shipdate, l_orderkey, l_linenumber, count(*) OVER () AS group_rows,
       row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS position FROM lineitem""",
    "repeated_lines": """
SELECT l_orderkey, l_linenumber, l_quantity, unnest(range(CAST(floor(l_quantity / 10) AS BIGINT))) AS copy FROM lineitem""",
    "join_lines": """
SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, CAST(l_partkey AS VARCHAR)) AS parts FROM lineitem GROUP BY 1""",
    "join_lines_skewed": """
SELECT CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_orderkey END AS parent,
       string_agg(CAST(l_partkey AS VARCHAR) || ';', '' ORDER BY l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR)) AS parts
FROM lineitem GROUP BY 1""",
    "child_pieces": """
SELECT l_returnflag, n // 1000 AS piece, string_agg(part, ',' ORDER BY n) AS parts
FROM (SELECT l_returnflag, CAST(l_partkey AS VARCHAR) AS part,
             row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR)) - 1 AS n FROM lineitem)
GROUP BY 1, 2""",
    "delta_sink": _SINK_DELTAS.format(delay="10 DAYS"),
    "delta_sink_undelayed": _SINK_DELTAS.format(delay="0 DAYS"),
    "late_captures": f"{_SINK.format(delay='5 DAYS')}\nSELECT wait_type, captured_at, wait_time_ms FROM captures, marks WHERE second AND captured_at <= m0",
    "lock_details": _ROLES.format(pairs="pairs"),
    "lock_details_resource": _ROLES.format(pairs="pairs_resource"),
    "wait_classes_blocker": _CLASS.format(
        link='g.session_id AS "granted_SPID",', group="g.session_id,", met="w.blocking_session_id = g.session_id", holders="count(DISTINCT g.n)", waiters="count(DISTINCT w.n)"
    ),
    "wait_classes_resource": _CLASS.format(
        link="", group="", met="g.request_status = 'GRANT' AND w.request_status <> 'GRANT'", holders=_HOLDERS, waiters=_WAITERS
    ),
    "waiting_sessions_blocker": 'SELECT "waiting_SPID", count(*) AS pairs FROM pairs GROUP BY 1',
    "waiting_sessions_resource": 'SELECT "waiting_SPID", count(*) AS pairs FROM pairs_resource GROUP BY 1',
    "lock_reports": """
WITH blocked AS (SELECT blocking_session_id AS session_id, min(session_id) AS lowest FROM requests WHERE blocking_session_id <> 0 GROUP BY 1),
shown AS (SELECT session_id AS report_of, 'locks' AS section, session_id FROM blocked
  UNION ALL SELECT session_id, 'blocked_locks', lowest FROM blocked)
SELECT report_of, section, session_id, l.request_mode, l.request_status, o.name AS locked_object, l.resource_type, count(*) AS total_locks
FROM shown JOIN tran_locks l USING (session_id)
LEFT JOIN object_names o ON o.db_id = l.db_id AND o.object_id = l.entity_id GROUP BY ALL""",
    "locking_report_overview": report_sql(_half_up),
    "locking_report_detailed": report_sql(_half_up, detailed=True, chains=True),
    "locking_report_database": report_sql(_half_up, "db_name = 'db_7'", "db_name = 'db_7'", detailed=True),
    "locking_report_database_id": report_sql(_half_up, "db_name = 'db_12'", "db_name = 'db_12'"),
    "locking_report_session": report_sql(_half_up, "session_id = 7", '"granted_SPID" = 7 OR "waiting_SPID" = 7', detailed=True),
    "locking_report_login": report_sql(
        _half_up,
        f"login_name = '{_LOGIN}'",
        f"login = '{_LOGIN}' OR waiting_login = '{_LOGIN}'",
        detailed=True,
        shot=_ALL_SHOT,
        couple=RELATIONS["pairs"].replace("snap", "shot"),
    ),
}

ORACLE = {name: _sql(body) for name, body in ORACLE.items()}
