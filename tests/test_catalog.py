from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import fleetvitals as fv


@pytest.fixture
def catalog(spark):
    objects = spark.createDataFrame(
        [(1000, 1, "big", False, 5), (1001, 9, "lost", False, 5), (1002, 1, "shipped", True, 5), (7, 1, "internal", False, 5),
         (1003, 1, "other", False, 6)],
        "object_id long, schema_id int, name string, is_ms_shipped boolean, database_id int",
    )
    indexes = spark.createDataFrame(
        [(o, i, f"ix{i}", 1, True, False) for o in (1000, 1001, 1002, 7, 1003) for i in (1, 2)], fv.RELATIONS["indexes"]
    )
    partitions = spark.createDataFrame(
        [(1000, 1, 11, 11, 100), (1000, 2, 12, 12, 100), (1000, 1, 13, 13, 50), (1001, 1, 14, 14, 0), (1002, 1, 15, 15, 1),
         (7, 1, 16, 16, 1), (1003, 1, 17, 17, 3)],
        fv.RELATIONS["partitions"],
    )
    units = spark.createDataFrame(
        [(11, 10, 9), (11, 3, 2), (12, 7, 7), (13, 1, 1), (14, 2, 1), (15, 5, 5), (16, 5, 5), (17, 128, 64)],
        fv.RELATIONS["allocation_units"],
    )
    return fv.Catalog(objects, indexes, partitions, units, spark.createDataFrame([(1, "dbo")], fv.RELATIONS["schemas"]))


def test_object_sizes_groups_by_row_count(catalog):
    got = {(r["table_name"], r["rows"]): (r["avg_KB_per_row"], r["total_MB"], r["used_MB"]) for r in fv.object_sizes(catalog).collect()}
    assert got == {
        ("dbo.big", 100): (Decimal("1.60"), Decimal("0.16"), Decimal("0.14")),
        ("dbo.big", 50): (Decimal("0.16"), Decimal("0.01"), Decimal("0.01")),
        (None, 0): (None, Decimal("0.02"), Decimal("0.01")),
        ("dbo.other", 3): (Decimal("341.33"), Decimal("1.00"), Decimal("0.50")),
    }


def test_object_sizes_rolled_up_and_by_index(catalog):
    rolled = {r["table_name"]: (r["rows"], r["total_MB"]) for r in fv.object_sizes(catalog, rollup_rows=True).collect()}
    assert rolled["dbo.big"] == (150, Decimal("0.16"))
    by_index = {(r["table_name"], r["index_name"], r["rows"]) for r in fv.object_sizes(catalog, by_index=True).collect()}
    assert by_index == {
        ("dbo.big", "ix1", 100), ("dbo.big", "ix2", 100), ("dbo.big", "ix1", 50), (None, "ix1", 0), ("dbo.other", "ix1", 3),
    }
    both = {(r["index_name"], r["rows"]) for r in fv.object_sizes(catalog, True, True).collect() if r["table_name"] == "dbo.big"}
    assert both == {("ix1", 150), ("ix2", 100)}


def test_object_sizes_over_databases(spark, catalog):
    dbs = spark.createDataFrame([(5, "b", "ONLINE"), (6, "a", "ONLINE"), (3, "model", "ONLINE")], fv.RELATIONS["databases"])
    got = fv.object_sizes_all(catalog, dbs).select("database_name", "table_name", "rows").collect()
    assert [tuple(r) for r in got] == [("a", "dbo.other", 3), ("b", "dbo.big", 100), ("b", None, 0), ("b", "dbo.big", 50)]
    assert {r["database_name"] for r in fv.object_sizes_all(catalog, dbs, "a,   nowhere").collect()} == {"a"}


def test_select_names(spark):
    dbs = spark.createDataFrame([(1, "master", ""), (5, "my db", ""), (6, "x", ""), (7, "y", "")], fv.RELATIONS["databases"])
    names = lambda csv: sorted(r["name"] for r in fv.select_names(dbs, csv).collect())
    assert names("all") == ["my db", "x", "y"]
    assert names("master, x,  unknown") == ["master", "x"]
    assert names("my db") == []


@pytest.fixture
def files(spark):
    dbs = spark.createDataFrame([(5, "a&b", "ONLINE"), (6, "em]pty", "ONLINE"), (2, "sys", "ONLINE")], fv.RELATIONS["databases"])
    masters = spark.createDataFrame(
        [(5, 2, "LOG", "l<1>", "flat.ldf"), (5, 1, "ROWS", "d", "C:\\x\\d.mdf")], fv.RELATIONS["master_files"]
    )
    return dbs, masters


def test_collation_scripts(files):
    got = {r["dbName"]: r for r in fv.collation_scripts(*files).collect()}
    assert set(got) == {"a&b", "em]pty"}
    assert got["a&b"]["attach_script"] == (
        "CREATE DATABASE [a&b] ON (FILENAME = N'C:\\x\\d.mdf'), (FILENAME = N'flat.ldf') FOR ATTACH;"
    )
    assert got["em]pty"]["attach_script"] is None
    assert got["em]pty"]["offline_script"] == "ALTER DATABASE em]pty SET OFFLINE WITH ROLLBACK IMMEDIATE;"
    assert got["a&b"]["detach_script"] == "exec sp_detach_db @dbname = 'a&b', @skipchecks = 'true';"


def test_move_commands(files):
    got = {r["dbName"]: r for r in fv.move_commands(*files, "S:\\", "E:\\", "D:\\").collect()}
    assert got["a&b"]["backup_command"] == "BACKUP DATABASE [a&b] TO DISK = 'S:\\a&b.bak' WITH INIT, STATS = 5;"
    assert got["a&b"]["restore_command"] == (
        "RESTORE DATABASE [a&b] FROM DISK = 'E:\\a&b.bak' WITH MOVE 'd' TO 'D:\\d.mdf', "
        "MOVE 'l<1>' TO 'D:\\flat.ldf', REPLACE, RECOVERY, STATS = 5;"
    )
    assert got["sys"]["restore_command"] is None


def test_placement_and_secondary_indexes(spark, rows):
    indexes = spark.createDataFrame(
        [(1, 0, None, 1, False, False), (1, 2, "a", 1, False, False), (1, 3, "b", 2, False, True), (2, 1, "c", 2, True, False)],
        fv.RELATIONS["indexes"],
    )
    groups = spark.createDataFrame([(1, "PRIMARY"), (2, "POSTS")], fv.RELATIONS["filegroups"])
    assert [r["object_id"] for r in rows(fv.placement_drift(indexes, groups, "POSTS"))] == [1]
    assert rows(fv.placement_drift(indexes, groups, "POSTS", object_id=2)) == []
    assert [r["name"] for r in rows(fv.secondary_indexes(indexes, 1))] == ["a"]
    assert [r["name"] for r in rows(fv.secondary_indexes(indexes, 1, enabled_only=False))] == ["a", "b"]
    fv.require_exists(groups, F.col("name") == "POSTS", "x")
    with pytest.raises(ValueError, match="no such group"):
        fv.require_exists(groups, F.col("name") == "NONE", "no such group")
