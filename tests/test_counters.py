import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

import fleetvitals as fv

WAITS = "wait_type string, wait_time_ms long, signal_wait_time_ms long, waiting_tasks_count long"


@pytest.fixture
def waits(spark):
    before = spark.createDataFrame(
        [("LOCK", 100, 10, 4), ("GONE", 50, 5, 2), ("RESET", 900, 90, 9), ("SAME", 7, 1, 3), ("WAITFOR", 1, 1, 1)], WAITS
    )
    after = spark.createDataFrame(
        [("LOCK", 1323, 33, 6), ("NEW", 40, 0, 8), ("RESET", 100, 10, 1), ("SAME", 9, 1, 3), ("WAITFOR", 9, 9, 9)], WAITS
    )
    return fv.active_waits(before), fv.active_waits(after)


def test_ignore_list_has_all_names():
    assert len(fv.IGNORED_WAITS) == len(set(fv.IGNORED_WAITS)) == 76


def test_active_waits_drops_idle_ignored_and_unnamed(spark, rows):
    df = spark.createDataFrame([("A", 1, 1, 0), ("B", 1, 1, 1), ("CHKPT", 1, 1, 1), (None, 1, 1, 1), ("C", 1, 1, None)], WAITS)
    assert [r["wait_type"] for r in rows(fv.active_waits(df))] == ["B"]
    listed = spark.createDataFrame([("B",)], "wait_type string")
    assert [r["wait_type"] for r in rows(fv.active_waits(df, listed))] == ["CHKPT"]
    assert [r["wait_type"] for r in rows(fv.active_waits(df, []))] == ["B", "CHKPT"]


def test_wait_delta(waits, rows):
    got = {r["wait_type"]: (r["wait_time_ms"], r["signal_wait_time_ms"], r["wait_count"]) for r in rows(fv.wait_delta(*waits))}
    assert got == {"LOCK": (1223, 23, 2), "GONE": (50, 5, 2), "NEW": (40, 0, 8), "RESET": (800, 80, 8)}


def test_wait_delta_null_on_reset(waits, rows):
    got = {r["wait_type"]: r["wait_count"] for r in rows(fv.wait_delta(*waits, reset="null"))}
    assert got == {"LOCK": 2, "GONE": None, "NEW": 8, "RESET": None}


def test_wait_delta_with_itself_is_empty(waits):
    assert fv.wait_delta(waits[0], waits[0]).isEmpty()


def test_wait_delta_per_server(spark, waits, rows):
    one, two = (w.withColumn("server_id", F.lit("a")) for w in waits)
    other = two.withColumn("server_id", F.lit("b"))
    got = fv.wait_delta(one, two.unionByName(other))
    assert {(r["server_id"], r["wait_type"]) for r in rows(got)} == {
        *[("a", k) for k in ("LOCK", "GONE", "NEW", "RESET")],
        *[("b", k) for k in ("LOCK", "NEW", "RESET", "SAME")],
    }


@pytest.mark.parametrize(
    ("order", "first"), [("wait_time", "LOCK"), ("avg_wait", "LOCK"), ("wait_count", "NEW"), ("anything", "NEW")]
)
def test_wait_report_order(waits, order, first):
    assert fv.wait_report(fv.wait_delta(*waits), order).first()["wait_type"] == first


def test_wait_report_figures(waits):
    row = fv.wait_report(fv.wait_delta(*waits)).first()
    assert row.asDict() == {
        "wait_type": "LOCK",
        "wait_count": 2,
        "avg_wait_time_ms": Decimal("611.50"),
        "wait_time_S": Decimal("1.2230"),
        "resource_wait_time_S": Decimal("1.2000"),
        "signal_wait_time_S": Decimal("0.0230"),
    }


@pytest.fixture
def io(spark):
    dbs = spark.createDataFrame([(5, "db", "ONLINE"), (6, "other", "ONLINE")], "database_id int, name string, state_desc string")
    files = spark.createDataFrame(
        [(5, 1, "ROWS", "f", "p"), (5, 2, "LOG", "g", "q"), (6, 1, "ROWS", "h", "r"), (9, 1, "ROWS", "x", "y")],
        fv.RELATIONS["master_files"],
    )
    before = spark.createDataFrame([(5, 1, 2**20, 10, 10240, 7, 5, 5120, 5, 12), (5, 2, 0, 9, 9, 9, 9, 9, 9, 9)], fv.RELATIONS["file_stats"])
    after = spark.createDataFrame([(5, 1, 3 * 2**19, 14, 20480, 7, 5, 5120, 5, 14), (5, 2, 0, 1, 1, 1, 1, 1, 1, 1)], fv.RELATIONS["file_stats"])
    return [fv.io_snapshot(dbs, files, s) for s in (before, after)]


def test_io_snapshot_keeps_files_without_counters(io, rows):
    got = {(r["name"], r["file_id"]): (r["file_size_mb"], r["num_of_reads"]) for r in rows(io[1])}
    assert got == {("db", 1): (Decimal("1.50"), 14), ("db", 2): (Decimal("0.00"), 1), ("other", 1): (None, None)}


def test_io_delta(io, rows):
    one = next(r for r in rows(fv.io_delta(*io)) if r["name"] == "db" and r["file_id"] == 1)
    assert one["reads"] == 4 and one["kbytes_read"] == Decimal("10.00") and one["kb_per_read"] == Decimal("2.50")
    assert one["read_latency_ms"] == Decimal("0.000")
    assert one["writes"] == 0 and one["kb_per_write"] is None and one["write_latency_ms"] is None
    assert one["avg_latency_ms"] == Decimal("2.000") and one["stall_ms_per_op"] == Decimal("0.500")
    assert one["file_size_mb"] == Decimal("1.50")


def test_io_delta_is_signed_after_a_restart(io, rows):
    log = next(r for r in rows(fv.io_delta(*io)) if r["file_id"] == 2)
    assert (log["reads"], log["kbytes_read"], log["read_latency_ms"]) == (-8, Decimal("-0.01"), Decimal("1.000"))


def test_io_delta_zero_stall_variant(io, rows):
    one = next(r for r in rows(fv.io_delta(*io, null_zero_stall=True)) if r["name"] == "db" and r["file_id"] == 1)
    assert one["read_latency_ms"] is None


def test_health_report(spark, rows):
    waits = spark.createDataFrame([("A", 5, 1, 2)], WAITS)
    dbs = spark.createDataFrame([(5, "db", "ONLINE")], fv.RELATIONS["databases"])
    files = spark.createDataFrame([(5, 1, "ROWS", "f", "p")], fv.RELATIONS["master_files"])
    stats = spark.createDataFrame([(5, 1, 1, 1, 1, 1, 1, 1, 1, 1)], fv.RELATIONS["file_stats"])
    side = {"wait_stats": waits, "databases": dbs, "master_files": files, "file_stats": stats}
    report = fv.health_report(side, {**side, "wait_stats": waits.withColumn("waiting_tasks_count", F.lit(5))})
    assert report["waits"].first()["wait_count"] == 3
    assert report["files"].first()["reads"] == 0


def _history(n, seed):
    draw = random.Random(seed)
    start = datetime(2024, 1, 1)
    # one key holds two thirds of all captures
    seen = {(draw.choice(["hot", "hot", "k1", "k2"]), start + timedelta(minutes=draw.randrange(20_000))) for _ in range(n)}
    return [(k, at, draw.randrange(1000), draw.randrange(50)) for k, at in sorted(seen)]


def _expected(history, change):
    out, last = [], {}
    for key, at, a, b in sorted(history):
        if key in last:
            was = last[key]
            out.append((key, was[0], at, change(a - was[1]), change(b - was[2])))
        last[key] = (at, a, b)
    return sorted(out, key=repr)


SCHEMA = "wait_type string, captured_at timestamp, a long, b long"


@pytest.mark.parametrize("bucket", [60, 86_400, 10**9])
@pytest.mark.parametrize(("mode", "change"), [("signed", lambda d: d), ("abs", abs), ("null", lambda d: d if d >= 0 else None)])
def test_counter_deltas(spark, bucket, mode, change):
    history = _history(400, 3)
    df = spark.createDataFrame([*history, (None, datetime(2024, 1, 1), 1, 1)], SCHEMA)
    got = fv.counter_deltas(df, ["wait_type"], ["a", "b"], mode=mode, bucket_seconds=bucket)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(history, change)


def test_delta_stream_takes_late_captures_in_order(spark, tmp_path):
    history = _history(120, 5)
    draw = random.Random(1)
    # captures arrive up to two hours late
    arrival = sorted(history, key=lambda r: r[1] + timedelta(minutes=draw.randrange(120)))
    end = [("end", datetime(2025, 1, 1), 0, 0)]
    for i in range(4):
        part = arrival[i * len(arrival) // 4 : (i + 1) * len(arrival) // 4] + (end if i == 3 else [])
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    deltas = fv.delta_stream(stream, ["wait_type"], ["a", "b"], delay="3 hours")
    writer = deltas.writeStream.format("parquet").option("path", str(tmp_path / "out"))
    writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == _expected(history, lambda d: d)


def test_a_key_without_times_keeps_its_rows(spark):
    kind = "captured_at int, wait_type string, wait_time_ms bigint, signal_wait_time_ms bigint, waiting_tasks_count bigint"
    before = spark.createDataFrame([(None, "A", 10, 1, 2), (None, "B", 99, 9, 9), (1, "B", 5, 1, 1)], kind)
    after = spark.createDataFrame([(None, "A", 25, 3, 5), (2, "B", 8, 1, 3)], kind)
    found = {r["wait_type"]: (r["wait_time_ms"], r["wait_count"]) for r in fv.wait_delta(before, after).collect()}
    assert found == {"A": (15, 3), "B": (3, 2)}


def test_a_side_is_its_latest_capture(spark):
    kind = "captured_at int, wait_type string, wait_time_ms bigint, signal_wait_time_ms bigint, waiting_tasks_count bigint"
    before = spark.createDataFrame([(1, "A", 100, 0, 1), (2, "A", 110, 0, 2)], kind)
    after = spark.createDataFrame([(3, "A", 120, 0, 5)], kind)
    assert [tuple(r) for r in fv.wait_delta(before, after).collect()] == [("A", 10, 0, 3)]


def test_null_keys_have_a_history(spark):
    history = spark.createDataFrame([(None, 1, 5), (None, 2, 9), ("k", 1, 1)], "key string, captured_at int, n bigint")
    history = history.withColumn("captured_at", F.timestamp_seconds("captured_at"))
    got = fv.counter_deltas(history, ["key"], ["n"]).collect()
    assert [(r["key"], r["n_delta"]) for r in got] == [(None, 4)]


def test_delta_stream_keeps_nulls(spark, tmp_path):
    """Counters that were not read: the stream gives what the batch form gives, ties included, in every mode."""
    start = datetime(2024, 1, 1)
    data = [("k", 0, 5, None), ("k", 1, None, 3), ("k", 1, 2**60 + 1, 3), ("k", 2, 2**60, 9), ("k", 3, 1, None), (None, 0, 1, 1), (None, 4, 0, 2)]
    frame = spark.createDataFrame([(k, start + timedelta(minutes=m), a, b) for k, m, a, b in data], SCHEMA)
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    for mode in ("signed", "abs", "null"):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        writer = fv.delta_stream(stream, ["wait_type"], ["a", "b"], delay="0 seconds", mode=mode).writeStream.format("parquet")
        writer = writer.option("path", str(tmp_path / f"out-{mode}")).option("checkpointLocation", str(tmp_path / f"progress-{mode}"))
        writer.trigger(availableNow=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / f"out-{mode}")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_time", "captured_at")})
        whole = fv.counter_deltas(frame, ["wait_type"], ["a", "b"], mode=mode).select(*got.columns)
        whole = whole.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_time", "captured_at")})
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, whole.collect()), key=repr)
