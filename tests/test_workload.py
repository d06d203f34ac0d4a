from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import fleetvitals as fv
from fleetvitals.operators.workload import SINGLE_PLAN


@pytest.fixture
def stats(spark):
    a, b = bytearray(b"\x01\xab"), bytearray(b"\x02")
    h1, h2 = bytearray(b"\x10"), bytearray(b"\x20")
    p1, p2 = bytearray(b"\x0a"), bytearray(b"\x0b")
    return spark.createDataFrame(
        [
            (a, h1, p1, 3, 9000, 1000, 5000, 30, 5, 20, 1024, 0, 1024, 1),
            (a, h1, p2, 2, 4000, 500, 3500, 10, 1, 9, 512, 256, 256, 0),
            (b, h2, p1, 1, 7999, 7999, 7999, 3, 3, 3, 0, 0, 0, 0),
        ],
        fv.RELATIONS["query_stats"],
    )


@pytest.fixture
def lookups(spark):
    text = spark.createDataFrame([(bytearray(b"\x10"), "select 1", None)], fv.RELATIONS["sql_text"])
    plans = spark.createDataFrame(
        [(bytearray(b"\x0b"), "plan b", 5), (bytearray(b"\x0a"), "plan a", 6)], fv.RELATIONS["query_plans"]
    )
    dbs = spark.createDataFrame([(5, "db5", "ONLINE")], fv.RELATIONS["databases"])
    return text, plans, dbs


def test_rollup(stats, rows):
    first = next(r for r in rows(fv.rollup_query_stats(stats)) if r["execution_count"] == 5)
    assert first["total_worker_time"] == 13000 and first["min_worker_time"] == 500 and first["max_worker_time"] == 5000
    assert first["total_grant_MB"] == Decimal("1.5000") and first["min_grant_MB"] == Decimal("0.0000")
    assert first["plan_handle"] == bytearray(b"\x0b") and first["other_plan"] == bytearray(b"\x0a")


def test_top_queries(stats, lookups):
    got = fv.top_queries(stats, *lookups).collect()
    assert [r["execution_count"] for r in got] == [5, 1]
    one = got[0]
    assert (one["database_name"], one["query_text"], one["query_plan"]) == ("db5", "select 1", "plan b")
    # (13000 - 5000 - 500) / 1000 / 3, truncated twice
    assert one["avg_time_ms"] == 2 and one["avg_logical_reads"] == (40 - 1 - 20) // 3
    assert one["avg_grant_MB"] == Decimal("0.3000")
    assert "X'01AB'" in one["diagnosis_query"]
    two = got[1]
    assert (two["query_text"], two["query_plan"], two["database_name"]) == (None, "plan a", None)
    assert two["avg_time_ms"] == 7 and two["diagnosis_query"] == SINGLE_PLAN
    assert len(fv.top_queries(stats, *lookups, n=1).collect()) == 1


def test_the_diagnosis_text_is_a_working_query(spark, stats, lookups):
    text, plans, _ = lookups
    for name, df in (("query_stats", stats), ("sql_text", text), ("query_plans", plans)):
        df.createOrReplaceTempView(name)
    sql = fv.top_queries(stats, *lookups).first()["diagnosis_query"]
    direct = fv.plans_for_query(stats, text, plans, bytearray(b"\x01\xab")).drop("query_hash")
    assert sorted(map(tuple, spark.sql(sql).collect())) == sorted(map(tuple, direct.collect()))
    assert direct.count() == 2


def test_plan_divergence(stats, rows):
    got = {bytes(r["query_hash"]): r["has_other_plans"] for r in rows(fv.plan_divergence(fv.rollup_query_stats(stats)))}
    assert got == {b"\x01\xab": True, b"\x02": False}


def test_index_usage_of_one_database(spark, rows):
    usage = spark.createDataFrame([(5, 1, 1, 1, 2, 3, 4), (6, 1, 1, 9, 9, 9, 9), (5, 2, 1, 7, 7, 7, 7)], fv.RELATIONS["index_usage"])
    indexes = spark.createDataFrame([(1, 1, "pk", 1, True, False), (1, 2, "unused", 1, False, False)], fv.RELATIONS["indexes"])
    objects = spark.createDataFrame([(1, 1, "t", False), (2, 1, "no index", False)], fv.RELATIONS["objects"])
    schemas = spark.createDataFrame([(1, "dbo")], fv.RELATIONS["schemas"])
    got = rows(fv.index_usage(usage, indexes, objects, schemas, database_id=5))
    assert got == [
        {"database_id": 5, "table_name": "dbo.t", "index_name": "pk", "user_seeks": 1, "user_scans": 2, "user_lookups": 3, "user_updates": 4}
    ]


def test_rollup_keeps_captures_apart(spark):
    # counters are cumulative: two captures of a plan are not summed
    columns = fv.RELATIONS["query_stats"]
    row = {"execution_count": 10, "total_worker_time": 100}
    names = [f.name for f in columns.fields]
    base = [tuple(row.get(n, bytearray(b"\x01") if n.endswith(("hash", "handle")) else 1) for n in names)]
    stats = spark.createDataFrame(base, columns)
    both = stats.withColumn("captured_at", F.lit(1)).union(stats.withColumn("captured_at", F.lit(2)))
    got = fv.rollup_query_stats(both).orderBy("captured_at").collect()
    assert [(r["captured_at"], r["execution_count"]) for r in got] == [(1, 10), (2, 10)]
