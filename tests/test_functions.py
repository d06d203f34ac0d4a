from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from fleetvitals.functions import base_name, div, fill, fixed_width, format_datetime, half_up, quote_name, trimmed_mean


def test_half_up_is_exact_on_a_grid(spark):
    pairs = spark.range(-300, 301).select(F.col("id").alias("n")).join(
        spark.range(-40, 41).select(F.col("id").alias("d")), F.lit(True)
    )
    got = pairs.select("n", "d", half_up(F.col("n"), F.col("d"), 2).alias("q")).collect()
    for r in got:
        if r["d"] == 0:
            assert r["q"] is None
        else:
            exact = (Decimal(r["n"]) / Decimal(r["d"])).quantize(Decimal("0.01"), ROUND_HALF_UP)
            assert r["q"] == exact, r


def test_half_up_large_counters(spark):
    n, d = 9 * 10**15 + 7, 3
    got = spark.range(1).select(half_up(F.lit(n), F.lit(d), 2, 36).alias("q")).first()["q"]
    assert got == (Decimal(n) / d).quantize(Decimal("0.01"), ROUND_HALF_UP)


def test_integer_division_truncates(spark):
    row = spark.range(1).select(div(F.lit(-7), 2).alias("a"), div(F.lit(7), 2).alias("b")).first()
    assert (row["a"], row["b"]) == (-3, 3)


def test_trimmed_mean_of_one_two_and_more(spark):
    df = spark.createDataFrame([(5000, 5000, 5000, 1), (9, 4, 5, 2), (10000, 1000, 4000, 5)], "t long, lo long, hi long, n long")
    got = [r["m"] for r in df.select(trimmed_mean(F.col("t"), F.col("lo"), F.col("hi"), F.col("n"), 1000).alias("m")).collect()]
    assert got == [5, None, 1]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a]b", "D:\\x\\y.mdf", "plain", None)], "n string, p string, q string, z string")
    row = df.select(
        quote_name(F.col("n")).alias("a"),
        base_name(F.col("p")).alias("b"),
        base_name(F.col("q")).alias("c"),
        fill("<{n}> & {p}", n=F.col("n"), p="x").alias("d"),
        fill("{z}!", z=F.col("z")).alias("e"),
        fixed_width(F.col("q"), 7).alias("f"),
        format_datetime(F.lit("2020-02-03 04:05:06").cast("timestamp")).alias("g"),
    ).first()
    assert tuple(row) == ("[a]]b]", "y.mdf", "plain", "<a]b> & x", None, "plain  ", "2020-02-03 04:05:06")


def test_fixed_width_rejects_longer_values(spark):
    df = spark.createDataFrame([("12345678",), ("1234567   ",)], "v string")
    assert df.where("v like '%7   '").select(fixed_width(F.col("v"), 7).alias("w")).first()["w"] == "1234567"
    with pytest.raises(Exception, match="longer than 7"):
        df.select(fixed_width(F.col("v"), 7)).collect()
