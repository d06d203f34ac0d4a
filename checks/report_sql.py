"""DuckDB SQL for the locking report by content: every section, row by row, in the report's order."""

from __future__ import annotations

from collections.abc import Callable

_PAIRS = """db_name resource_type locked_object_name resource lock_mode lock_status granted_SPID login host locking_query
 locking_session_status tran_cnt waiting_lock_mode waiting_SPID waiting_login waiting_host waiter_blocking_session
 waiting_query waiter_tran_cnt""".split()
_SESSIONS = """session_id login_name host_name status open_transaction_count isolation_level text locks_in_dbs granted_locks
 waiting_locks objects_with_granted_locks objects_with_waiting_locks nonintent_objects_granted_locks blocker_mark""".split()
_PROFILE = "login_name host_name status blocking_session_id transaction_il text open_transaction_count".split()
_OBJECTS = """db_name object_name overall_locks granted_locks sessions_with_granted_locks waiting_sessions waiting_locks
 object_nonintent_locks_granted object_locks_waiting key_locks_granted key_locks_waiting page_locks_granted
 page_locks_waiting key_locks_pctg locks_in_db_overall tbl_locks_in_db_pctg""".split()
_DETAIL = """session_id login_name host_name status db_name object_name resource_type resource_description hobt_id request_type
 request_status request_mode open_transaction_count text""".split()
_RANK = "CASE {kind} WHEN 'OBJECT' THEN 1 WHEN 'EXTENT' THEN 2 WHEN 'PAGE' THEN 3 ELSE 4 END"


def _text(columns: list[str]) -> str:
    cells = (f"""'{c}=' || coalesce(CAST("{c}" AS VARCHAR), 'NULL')""" for c in columns)
    return f"concat_ws('|', {', '.join(cells)})"


def _section(name: str, columns: list[str], order: list[str], source: str) -> str:
    by = ", ".join(o if " DESC" in o else f"{o} NULLS FIRST" for o in order)
    return f"SELECT '{name}' AS section, row_number() OVER (ORDER BY {by}) AS row_number, {_text(columns)} AS content FROM ({source})"


def _detail(name: str, who: str, hits: str, waits: bool) -> str:
    """A session's lock rows, each once; those of a contended resource marked."""
    status = "CASE WHEN s.request_status = 'GRANT' THEN 'GRANT' ELSE '___' || s.request_status || '___' END" if waits else "s.request_status"
    columns = [*_DETAIL, *(["blocking_session_id"] if waits else [])]
    raw = ", ".join(f"s.{c} AS raw_{c}" for c in [*_DETAIL, "blocking_session_id"])
    source = f"""
SELECT s.* REPLACE ({status} AS request_status, CASE WHEN EXISTS (SELECT 1 FROM {hits} h WHERE h.session_id = s.session_id
    AND h.locked_object_name = s.object_name AND h.resource_type = s.resource_type AND h.resource = s.resource_description)
  THEN '___' || s.object_name || '___' ELSE s.object_name END AS object_name), {raw}
FROM shot s WHERE s.session_id IN ({who})"""
    order = ["raw_session_id", "raw_db_name", "raw_object_name", _RANK.format(kind="raw_resource_type"), *[f"raw_{c}" for c in [*_DETAIL, "blocking_session_id"]]]
    return _section(name, columns, order, source)


def report_sql(
    half_up: Callable[..., str],
    rows: str = "true",
    pairs: str = "true",
    detailed: bool = False,
    chains: bool = False,
    shot: str = "SELECT * FROM snap",
    couple: str = "SELECT * FROM pairs",
) -> str:
    """The report; ``rows`` and ``pairs`` are the filters of lock rows and of pairs."""
    percent = lambda part, whole: half_up(f"({part} * 100)", whole, 2)
    group = ", ".join(["session_id", *_PROFILE])
    ctes = f"""
WITH shot AS ({shot}),
couples AS (SELECT * FROM ({couple}) WHERE {pairs}),
couple_counts AS (SELECT "waiting_SPID", count(*) AS n FROM couples GROUP BY 1),
picked AS (SELECT *, request_status = 'GRANT' AS held, request_status <> 'GRANT' AS awaited, resource_type = 'OBJECT' AS whole_object,
    resource_type IN ('KEY', 'RID') AS row_lock, resource_type = 'PAGE' AS page, NOT starts_with(request_mode, 'I') AS plain
  FROM shot WHERE {rows}),
held_in AS (SELECT DISTINCT "granted_SPID" AS session_id, locked_object_name, resource_type, resource FROM couples),
awaited_in AS (SELECT DISTINCT "waiting_SPID" AS session_id, locked_object_name, resource_type, resource FROM couples),
level_names(code, level_name) AS (VALUES (0, 'Unspecified'), (1, 'Read Uncommitted'), (2, 'Read Committed'), (3, 'Repeatable Read'),
  (4, 'Serializable'), (5, 'Snapshot')),
session_tally AS (SELECT {group}, count(DISTINCT db_name) AS locks_in_dbs, count(*) FILTER (held) AS granted_locks,
    count(*) FILTER (awaited) AS waiting_locks, count(DISTINCT object_name) FILTER (held) AS objects_with_granted_locks,
    count(DISTINCT object_name) FILTER (awaited) AS objects_with_waiting_locks,
    count(DISTINCT object_name) FILTER (held AND whole_object AND plain) AS nonintent_objects_granted_locks
  FROM picked GROUP BY {group}),
session_rows AS (SELECT t.* REPLACE (CASE WHEN granted_locks > 0 AND status = 'sleeping' THEN 'SLEEPING' ELSE status END AS status),
    {", ".join(f"t.{c} AS raw_{c}" for c in _PROFILE)},
    CASE WHEN transaction_il = 2 AND session_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
         THEN 'Read Committed Snapshot' ELSE coalesce(level_name, 'UNKNOWN') END AS isolation_level,
    CASE WHEN session_id IN (SELECT session_id FROM held_in) THEN 'V' ELSE '' END AS blocker_mark
  FROM session_tally t LEFT JOIN level_names ON code = transaction_il),
object_tally AS (SELECT db_name, object_name, count(*) AS overall_locks, count(*) FILTER (held) AS granted_locks,
    count(DISTINCT session_id) FILTER (held) AS sessions_with_granted_locks,
    count(DISTINCT session_id) FILTER (awaited) AS waiting_sessions, count(*) FILTER (awaited) AS waiting_locks,
    count(*) FILTER (whole_object AND plain AND held) AS object_nonintent_locks_granted,
    count(*) FILTER (whole_object AND awaited) AS object_locks_waiting, count(*) FILTER (row_lock AND held) AS key_locks_granted,
    count(*) FILTER (row_lock AND awaited) AS key_locks_waiting, count(*) FILTER (page AND held) AS page_locks_granted,
    count(*) FILTER (page AND awaited) AS page_locks_waiting, count(*) FILTER (row_lock) AS key_locks
  FROM picked GROUP BY ALL),
db_tally AS (SELECT db_name, count(*) AS locks_in_db_overall FROM picked GROUP BY ALL),
object_rows AS (SELECT t.*, {percent("key_locks", "overall_locks")} AS key_locks_pctg, locks_in_db_overall,
    {percent("overall_locks", "locks_in_db_overall")} AS tbl_locks_in_db_pctg FROM object_tally t JOIN db_tally USING (db_name))"""
    first = ["db_name", "n DESC", "locked_object_name", _RANK.format(kind="resource_type"), '"granted_SPID"']
    parts = [
        _section("wait_pairs", _PAIRS, [*first, *(f'"{c}"' for c in _PAIRS)], 'SELECT * FROM couples JOIN couple_counts USING ("waiting_SPID")'),
        _section(
            "sessions",
            _SESSIONS,
            [
                "CASE blocker_mark WHEN 'V' THEN 0 ELSE 1 END",
                "CASE blocker_mark WHEN 'V' THEN 9999 ELSE waiting_locks END DESC",
                "granted_locks DESC",
                "session_id",
                *(f"raw_{c}" for c in _PROFILE),
            ],
            "SELECT * FROM session_rows",
        ),
        _section("objects", _OBJECTS, ["waiting_locks DESC", "db_name", "object_name"], "SELECT * FROM object_rows"),
    ]
    if detailed:
        holds, waits = "SELECT session_id FROM held_in", "SELECT session_id FROM awaited_in"
        parts += [
            _detail("head_blockers", f"{holds} EXCEPT {waits}", "held_in", False),
            _detail("mid_blockers", f"{holds} INTERSECT {waits}", "held_in", True),
            _detail("leaf_waiters", f"{waits} EXCEPT {holds}", "awaited_in", True),
        ]
    if chains:
        source = """
SELECT c.session_id, min(coalesce(CAST(p.blocking_session_id AS VARCHAR) || ' -> ', '') || CAST(c.blocking_session_id AS VARCHAR)) AS above,
       min(coalesce(CAST(p.blocking_session_id AS VARCHAR) || ' -> ', '') || CAST(c.blocking_session_id AS VARCHAR))
         || ' -> ' || CAST(c.session_id AS VARCHAR) AS blocking_chain
FROM (SELECT DISTINCT session_id, blocking_session_id FROM shot) c
JOIN (SELECT DISTINCT session_id, blocking_session_id FROM shot) p ON c.blocking_session_id = p.session_id GROUP BY c.session_id"""
        parts.append(_section("blocking_chains", ["session_id", "blocking_chain"], ["above", "session_id"], source))
    return ctes + "\n" + "\nUNION ALL ".join(parts)
