import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import fleetvitals as fv


@pytest.fixture(scope="module")
def data():
    """Half of the rows are in one group, and most of those are equal in the order."""
    draw = random.Random(3)
    return [(draw.choice(["a", "a", "a", "b", None]), draw.choice([1, 1, 1, 2, None]), i) for i in range(400)]


def test_numbers_follow_the_order_without_gaps(spark, data):
    rows = spark.createDataFrame(data, "g string, v int, id int").repartition(7)
    got = fv.number_rows(rows, [F.desc("v"), "id"], within=["g"]).collect()
    assert Counter((r["g"], r["v"], r["id"]) for r in got) == Counter(data)
    for group in ("a", "b", None):
        wanted = sorted((r for r in data if r[0] == group), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        mine = sorted((r for r in got if r["g"] == group), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(len(wanted)))
        assert [r["id"] for r in mine] == [r[2] for r in wanted]
        assert {r["group_rows"] for r in mine} <= {len(wanted)}


def test_a_tie_spreads_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 8).select(F.lit(1).alias("same"))
    got = fv.number_rows(rows, ["same"]).withColumn("task", F.spark_partition_id())
    assert sorted(r["position"] for r in got.collect()) == list(range(5000))


def test_numbers_in_any_order(spark, data):
    rows = spark.createDataFrame(data, "g string, v int, id int").repartition(5)
    got = fv.number_any(rows, "at").collect()
    assert sorted(r["at"] for r in got) == list(range(400)) and {r["id"] for r in got} == set(range(400))
    # a sorted frame is numbered in its order
    ordered = fv.number_any(rows.orderBy(F.desc("id")), "at").orderBy("at").collect()
    assert [r["id"] for r in ordered] == list(range(399, -1, -1))


def test_repeated_rows(spark):
    rows = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, -2), (5, 1)], "id int, n int")
    got = sorted((r["id"], r["copy"]) for r in fv.repeat_rows(rows, F.col("n")).collect())
    assert got == [(1, 0), (1, 1), (1, 2), (5, 0)]


def test_nothing_to_number(spark):
    none = spark.createDataFrame([], "g string, v int")
    assert fv.number_rows(none, ["v"], within=["g"]).count() == fv.number_any(none).count() == 0


def test_generated_rows_follow_a_table(spark, data):
    rows = spark.createDataFrame(data, "g string, v int, id int").repartition(3)
    assert sorted(r["task_id"] for r in fv.generate_tasks(rows).collect()) == list(range(1, 401))
    assert sorted(r["task_id"] for r in fv.generate_tasks(rows, 5).collect()) == [1, 2, 3, 4, 5]


def test_pieces_of_a_large_parent(spark):
    """A parent with most of the rows: pieces in order give the whole, ties and nulls included."""
    draw = random.Random(9)
    rows = [(draw.choice([1, 1, 1, 2, None]), draw.randrange(50), draw.choice([None, "x", "yy", "z"])) for _ in range(3000)]
    frame = spark.createDataFrame(rows, "parent int, place int, body string").repartition(6)
    pieces = fv.child_pieces(frame, "parent", F.col("body"), ",", "place", "texts", piece_texts=7).collect()
    whole = {r["parent"]: r["texts"] for r in fv.join_children(frame, "parent", F.col("body"), ",", "place", "texts").collect()}
    for parent in (1, 2, None):
        wanted = [b for _, b in sorted((p, b) for g, p, b in rows if g == parent and b is not None)]
        mine = sorted((r for r in pieces if r["parent"] == parent), key=lambda r: r["piece"])
        assert [r["piece"] for r in mine] == list(range(-(-len(wanted) // 7)))
        assert ",".join(r["texts"] for r in mine) == whole[parent] == ",".join(wanted)
