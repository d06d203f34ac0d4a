from collections import Counter
from datetime import datetime, timedelta

import pytest

import fleetvitals as fv

START = datetime(2024, 1, 1)
SCHEMA = "server string, captured_at timestamp_ntz, reads bigint, writes bigint"


def _at(minutes):
    return START + timedelta(minutes=minutes)


def _run(spark, tmp_path, batches, **options):
    """Every list of rows arrives as one micro-batch."""
    landed = tmp_path / "landed"
    landed.mkdir()
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(landed))
    out = str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame([(s, _at(m) if m is not None else None, *c) for s, m, *c in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(landed))
        writer = fv.delta_sink(stream, ["server"], ["reads", "writes"], out, **options)
        writer.option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start().awaitTermination()
    read = lambda part: spark.read.parquet(f"{out}/{part}")
    deltas = Counter((r["server"], r["from_time"], r["captured_at"], r["reads_delta"], r["writes_delta"]) for r in read("deltas").collect())
    late = sorted((r["server"], r["captured_at"]) for r in read("late").where("captured_at IS NOT NULL").collect())
    return deltas, late, out


def test_batches_equal_the_whole_history(spark, tmp_path):
    """Out of order within the delay, nulls and ties: as the batch form over all rows."""
    batches = [
        [("a", 0, 5, 1), ("a", 30, 9, None), ("b", 10, 1, 1), (None, 5, 1, 1)],
        [("a", 20, 7, 3), ("b", 25, None, 4), ("a", 60, 4, 4), (None, 50, 2, 0)],
        [("a", 50, 1, 9), ("a", 50, 1, 9), ("b", 70, 8, 8), ("c", 300, 0, 0)],
    ]
    deltas, late, _ = _run(spark, tmp_path, batches, delay="45 minutes", expiry=None)
    seen = [(s, _at(m), *c) for rows in batches for s, m, *c in rows]
    history = spark.createDataFrame(seen, SCHEMA)
    whole = fv.counter_deltas(history, ["server"], ["reads", "writes"]).where(f"captured_at <= timestamp_ntz'{_at(255)}'")
    assert not late and deltas == Counter((r["server"], r["from_time"], r["captured_at"], r["reads_delta"], r["writes_delta"]) for r in whole.collect())
    assert any(k[4] is None for k in deltas)


def test_late_and_timeless_captures_are_kept_aside(spark, tmp_path):
    batches = [[("a", 0, 1, 1), ("a", 100, 2, 2)], [("a", 50, 9, 9), ("a", 91, 3, 3), ("a", None, 4, 4)], [("a", 200, 5, 5)]]
    deltas, late, out = _run(spark, tmp_path, batches, delay="10 minutes")
    assert late == [("a", _at(50))] and spark.read.parquet(f"{out}/late").count() == 2
    assert deltas == Counter({("a", _at(0), _at(91), 2, 2): 1, ("a", _at(91), _at(100), -1, -1): 1})


def test_a_silent_key_leaves_the_state(spark, tmp_path):
    batches = [[("a", 0, 1, 1), ("b", 0, 1, 1)], [("b", 200, 2, 2)], [("a", 210, 9, 9), ("b", 220, 3, 3)]]
    deltas, late, out = _run(spark, tmp_path, batches, delay="0 minutes", expiry="100 minutes")
    assert not late and sorted(k[0] for k in deltas) == ["b", "b"]
    assert spark.read.parquet(f"{out}/state/0").where("_kind <> 'mark'").count() == 2


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    from fleetvitals.streaming.sink import DeltaBatches

    step = DeltaBatches(["server"], ["reads", "writes"], str(tmp_path / "out"), "captured_at", "0 minutes", None, "signed")
    for number, rows in ((0, [("a", 0, 1, 1)]), (1, [("a", 5, 4, 4)]), (1, [("a", 5, 4, 4)]), (2, [("a", 9, 5, 5)])):
        step(spark.createDataFrame([(s, _at(m), *c) for s, m, *c in rows], SCHEMA), number)
    got = sorted(r["reads_delta"] for r in spark.read.parquet(str(tmp_path / "out" / "deltas")).collect())
    assert got == [1, 3]


@pytest.mark.parametrize("mode, wanted", [("abs", 3), ("null", None)])
def test_modes(spark, tmp_path, mode, wanted):
    deltas, _, _ = _run(spark, tmp_path, [[("a", 0, 5, 5), ("a", 1, 2, 5)]], delay="0 minutes", mode=mode)
    assert [k[3] for k in deltas] == [wanted]
