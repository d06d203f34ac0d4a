"""Telemetry relations: the columns the operators read, with their types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TYPES = {
    "int": T.IntegerType(),
    "long": T.LongType(),
    "string": T.StringType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
}


def _relation(columns: str) -> T.StructType:
    fields = []
    for item in columns.split(","):
        name, kind = item.split()
        fields.append(T.StructField(name, _TYPES[kind], True))
    return T.StructType(fields)


RELATIONS: dict[str, T.StructType] = {
    "wait_stats": _relation(
        "wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long"
    ),
    "databases": _relation("database_id int, name string, state_desc string"),
    "master_files": _relation(
        "database_id int, file_id long, type_desc string, name string, physical_name string"
    ),
    "file_stats": _relation(
        "database_id int, file_id long, size_on_disk_bytes long, num_of_reads long, num_of_bytes_read long,"
        "io_stall_read_ms long, num_of_writes long, num_of_bytes_written long, io_stall_write_ms long,"
        "io_stall long"
    ),
    "query_stats": _relation(
        "query_hash binary, sql_handle binary, plan_handle binary, execution_count long,"
        "total_worker_time long, min_worker_time long, max_worker_time long,"
        "total_logical_reads long, min_logical_reads long, max_logical_reads long,"
        "total_grant_kb long, min_grant_kb long, max_grant_kb long, total_spills long"
    ),
    "sql_text": _relation("sql_handle binary, text string, dbid int"),
    "query_plans": _relation("plan_handle binary, query_plan string, dbid int"),
    "index_usage": _relation(
        "database_id int, object_id long, index_id int, user_seeks long, user_scans long,"
        "user_lookups long, user_updates long"
    ),
    "indexes": _relation(
        "object_id long, index_id int, name string, data_space_id int, is_unique boolean, is_disabled boolean"
    ),
    "objects": _relation("object_id long, schema_id int, name string, is_ms_shipped boolean"),
    "schemas": _relation("schema_id int, name string"),
    "partitions": _relation("object_id long, index_id int, partition_id long, hobt_id long, rows long"),
    "allocation_units": _relation("container_id long, total_pages long, used_pages long"),
    "filegroups": _relation("data_space_id int, name string"),
    "tran_locks": _relation(
        "resource_type string, resource_description string, resource_associated_entity_id long,"
        "resource_database_id int, request_type string, request_status string, request_mode string,"
        "request_session_id long"
    ),
    "sessions": _relation(
        "session_id long, login_name string, host_name string, status string, open_transaction_count int,"
        "transaction_isolation_level int, is_user_process int"
    ),
    "connections": _relation("session_id long, most_recent_sql_handle binary"),
    "requests": _relation("session_id long, blocking_session_id long, transaction_isolation_level int"),
    "active_snapshot_tx": _relation("session_id long"),
    "job_ledger": _relation(
        "dbName string, backup_command string, offline_command string, restore_command string, processed int,"
        "creation_dt timestamp, start_dt timestamp, finish_dt timestamp, error_msg string"
    ),
    "tasks": _relation("uuid string, task_id long, stage int, valid_to timestamp"),
    "sequence": _relation("i int, d timestamp, v string"),
}

# A handle is an opaque key: captures that land it as a number or as text are as good as binary ones.
# Whole numbers may arrive in any integer width, timestamps with or without zone.
_HANDLE = {"binary", "string", "bigint", "int"}
_WHOLE = {"tinyint", "smallint", "int", "bigint"}
_ACCEPTED = {
    "binary": _HANDLE,
    "int": _WHOLE,
    "bigint": _WHOLE,
    "timestamp": {"timestamp", "timestamp_ntz"},
    "boolean": {"boolean"},
    "string": {"string"},
}


def conform(df: DataFrame, relation: str) -> DataFrame:
    """Check a frame against a relation: every column there and of a usable type, else ``ValueError``.

    Columns beyond the relation (fleet keys, for instance) pass through.
    """
    found = dict(df.dtypes)
    problems = []
    for field in RELATIONS[relation].fields:
        wanted = field.dataType.simpleString()
        if field.name not in found:
            problems.append(f"column {field.name} is missing")
        elif found[field.name] not in _ACCEPTED[wanted]:
            problems.append(f"column {field.name} is {found[field.name]}, expected {wanted}")
    if problems:
        raise ValueError(f"{relation}: " + "; ".join(problems))
    return df
