import pytest
from pyspark.sql import types as T

import fleetvitals as fv


@pytest.fixture
def waits(spark):
    return spark.createDataFrame([("A", 1, 2, 3)], fv.RELATIONS["wait_stats"])


def test_relations_are_checked(spark, waits, tmp_path):
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    waits.write.parquet(good)
    waits.drop("wait_time_ms").selectExpr("*", "1.5 as signal").drop("signal_wait_time_ms").write.parquet(bad)
    assert fv.read_relation(spark, good, "wait_stats").count() == 1
    with pytest.raises(ValueError, match="wait_time_ms is missing"):
        fv.read_relation(spark, bad, "wait_stats")
    with pytest.raises(ValueError, match="is string, expected bigint"):
        fv.conform(waits.selectExpr("wait_type", "'1' wait_time_ms", "signal_wait_time_ms", "waiting_tasks_count"), "wait_stats")
    own = T.StructType([T.StructField("wait_type", T.StringType())])
    assert fv.read_relation(spark, good, own).columns == ["wait_type"]


def test_text_relations_take_the_declared_types(spark, waits, tmp_path):
    waits.write.option("header", True).csv(str(tmp_path / "csv"))
    waits.write.json(str(tmp_path / "json"))
    waits.write.orc(str(tmp_path / "orc"))
    for kind in ("csv", "json", "orc"):
        options = {"header": "true"} if kind == "csv" else {}
        got = fv.read_relation(spark, str(tmp_path / kind), "wait_stats", kind, **options)
        assert got.collect() == waits.collect(), kind


def test_snapshots(spark, waits, tmp_path):
    both = fv.append_snapshot(fv.capture(waits), fv.capture(waits, fv.AFTER))
    assert sorted(r["snapshot_id"] for r in both.collect()) == [1, 10]
    path = str(tmp_path / "s")
    fv.write_snapshot(fv.capture(waits), path)
    fv.write_snapshot(fv.capture(waits, fv.AFTER), path)
    stored = spark.read.parquet(path).where("snapshot_id = 10")
    assert stored.count() == 1
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan


def test_load_or_build(spark, waits, tmp_path):
    path, built = str(tmp_path / "s"), []

    def build(df):
        return lambda: built.append(1) or df

    assert fv.load_or_build(spark, path, build(waits), refresh=False).count() == 1
    assert fv.load_or_build(spark, path, build(waits), refresh=False).count() == 1 and len(built) == 1
    assert fv.load_or_build(spark, path, build(waits.limit(0))).count() == 0 and len(built) == 2
    assert fv.load_or_build(spark, path, build(waits), refresh=False).count() == 1 and len(built) == 3


def test_fan_out(spark, waits, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    fv.fan_out(waits, {a: None, b: ["wait_type"]})
    assert spark.read.parquet(a).columns == waits.columns and spark.read.parquet(b).collect() == [("A",)]
