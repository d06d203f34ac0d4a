import hashlib
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

import fleetvitals as fv

NOW = datetime(2024, 5, 1, 12, 0, 0)


def test_generated_tasks(spark):
    tasks = fv.generate_tasks(spark, as_of=NOW).collect()
    assert len(tasks) == 4096 and len({r["uuid"] for r in tasks}) == 4096
    assert {r["task_id"] for r in tasks} == set(range(1, 4097))
    assert all(r["stage"] == r["task_id"] % 10 and r["valid_to"] == NOW for r in tasks)


def test_generated_sequence(spark):
    got = fv.generate_sequence(spark, 3, datetime(2020, 1, 1)).orderBy("i").collect()
    assert [tuple(r) for r in got] == [(n, datetime(2020, 1, 1, 0, 0, n), str(n)) for n in (1, 2, 3)]


def test_defaults_fill_only_gaps(spark):
    df = spark.createDataFrame([("k", NOW), (None, None)], "uuid string, valid_to timestamp")
    got = fv.with_defaults(df, as_of=datetime(2000, 1, 1, 0, 0, 0, 900_000)).collect()
    assert tuple(got[0]) == ("k", NOW)
    assert len(got[1]["uuid"]) == 36 and got[1]["valid_to"] == datetime(2000, 1, 1)


@pytest.fixture
def tasks(spark):
    rows = [(f"u{i}", i, i % 10, NOW) for i in range(300)] + [("never", 999, 0, None)]
    return spark.createDataFrame(rows, fv.RELATIONS["tasks"])


def test_sample_is_exact_and_repeatable(tasks):
    draw = lambda df, seed: {r["uuid"] for r in fv.sample_exact(df, 50, seed=seed).collect()}
    assert len(draw(tasks, 1)) == 50
    assert draw(tasks, 1) == draw(tasks.repartition(7), 1) != draw(tasks, 2)
    assert fv.sample_exact(tasks, 1000).count() == 301


def test_update_where_in_changes_those_keys_only(spark, tasks):
    keys = spark.createDataFrame([("u1",), ("u1",), ("u2",), ("absent",)], "uuid string")
    got = fv.update_where_in(tasks, keys, "uuid", {"stage": F.col("stage") + 1})
    changed = got.exceptAll(tasks).collect()
    assert {(r["uuid"], r["stage"]) for r in changed} == {("u1", 2), ("u2", 3)} and got.count() == 301


def test_update_all_and_delete(tasks):
    moved = fv.update_all(tasks, {"valid_to": fv.add_seconds("valid_to", "task_id")})
    assert moved.where("uuid = 'u60'").first()["valid_to"] == datetime(2024, 5, 1, 12, 1, 0)
    assert moved.where("uuid = 'never'").first()["valid_to"] is None
    left = fv.delete_expired(moved, ahead_seconds=100, as_of=NOW)
    assert left.count() == 101 and left.where("uuid = 'never'").count() == 1
    assert left.agg(F.max("valid_to")).first()[0] == datetime(2024, 5, 1, 12, 1, 39)


@pytest.mark.parametrize("share", [1, 2, 64])
def test_repeat_update_is_the_same_with_any_share(tasks, share):
    rounds, n = 6, 20
    keys = [r["uuid"] for r in tasks.collect()]
    hits = Counter()
    for r in range(1, rounds + 1):
        hits.update(sorted(keys, key=lambda k: (hashlib.md5(f"{r}:{k}".encode()).hexdigest(), k))[:n])
    got = fv.repeat_update(tasks, rounds=rounds, n=n, share=share)
    before = {r["uuid"]: r["stage"] for r in tasks.collect()}
    assert {r["uuid"]: r["stage"] - before[r["uuid"]] for r in got.collect()} == {k: hits[k] for k in keys}
    assert got.schema["stage"].dataType == tasks.schema["stage"].dataType


def test_top_k_and_fixed_width(tasks):
    assert [r["task_id"] for r in fv.top_k(tasks.where("valid_to is not null"), ["valid_to", "task_id"], 3).collect()] == [0, 1, 2]
    assert fv.to_fixed_width(tasks, "uuid", 7).where("uuid = 'u1     '").count() == 1
