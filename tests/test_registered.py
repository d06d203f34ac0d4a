"""Every registered query: equal to its SQL at the smallest scale, and with a plan that scales."""

import re

import pytest

import __spark_entry__ as contract
from checks.compare import database, differences
from checks.inputs import Telemetry
from checks.queries import REGISTRY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return database(FOLDER)


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, connection, name):
    df = contract.queries()[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    for line in plan.splitlines():
        if re.search(r"\bWindow \[", line):
            # expressions, partition keys and order: a window without keys has only two lists
            assert line.count("], [") == 2, line
    count, found = differences(df, connection, name)
    assert not found
    assert count > 0


def test_lock_rows_and_requests_read_one_shuffle_of_the_lines(spark):
    """With joins planned as on large tables, the lines are scanned and shuffled by order once."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    df, kept = contract.queries()["lock_snapshot"](spark, FOLDER), {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    assert plan.count("/lineitem.parquet") == plan.count("/orders.parquet") == 1


def test_lines_are_shuffled_by_part_once_for_lock_rows_and_requests(spark):
    """With joins planned as on large tables, and as one number beside the part."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    df, kept = contract.queries()["lock_snapshot"](spark, FOLDER), {k: spark.conf.get(k) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        plan = df.select("*")._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)
    by_part = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(l_partkey#\d+L, \d+\), REPARTITION", line)]
    assert len([line for line in by_part if "ReusedExchange" not in line]) == 1
    assert not re.search(r"Exchange hashpartitioning\(l_partkey#\d+L, l_linenumber", plan)


def test_lock_rows_and_requests_of_odd_lines(spark, tmp_path):
    """Keys that are null or negative go through the packed number as they are."""
    lines = [(1, 7, 4, "A", "F"), (2, 7, 4, "N", "O"), (3, 7, 4, "R", None), (4, 7, 4, "A", "O"), (1, None, 4, "A", "O"), (None, 7, 4, "A", "O"), (3, 8, None, "A", "O")]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_linenumber int, l_returnflag string, l_linestatus string"),
        "orders": ([(1, -5), (2, 30), (3, None), (4, 1 << 40)], "o_orderkey long, o_custkey long"),
        "part": ([(7, 9), (8, 9)], "p_partkey long, p_size int"),
        "customer": ([(k, 100.0, 3) for k in (-5, 30, 1 << 40)], "c_custkey long, c_acctbal double, c_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    t = Telemetry(spark, str(tmp_path))
    got = {(r["request_session_id"], r["resource_type"], r["request_status"], r["request_mode"]) for r in t.tran_locks.collect()}
    assert got == {(-5, "KEY", "GRANT", "S"), (30, "KEY", "CONVERT", "IX"), (None, "KEY", "WAIT", "X"), (1 << 40, "KEY", "WAIT", "S")}
    assert {r["session_id"]: r["blocking_session_id"] for r in t.requests.collect()} == {-5: None, 30: -5, 1 << 40: -5}
