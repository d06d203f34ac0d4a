from datetime import datetime

import pytest

import fleetvitals as fv

T1, T2, T3, T4 = (datetime(2024, 1, d) for d in (1, 2, 3, 4))


@pytest.fixture
def ledger(spark):
    entries = [(n, None, None, f"restore {n}", None, T1, None, None, None) for n in ("a", "b", "c", "d")]
    return spark.createDataFrame(entries, fv.RELATIONS["job_ledger"])


@pytest.fixture
def events(spark):
    return spark.createDataFrame(
        [("a", T1, "started", None), ("a", T2, "succeeded", None), ("b", T2, "started", None), ("b", T3, "failed", "disk"),
         ("c", T1, "failed", "early"), ("c", T4, "succeeded", None), ("zz", T1, "failed", "unknown job")],
        "dbName string, event_dt timestamp, event string, error_msg string",
    )


def _by_name(df):
    return {r["dbName"]: (r["processed"], r["start_dt"], r["finish_dt"], r["error_msg"]) for r in df.collect()}


def test_events_touch_their_own_job_only(ledger, events):
    assert _by_name(fv.apply_events(ledger, events)) == {
        "a": (0, T1, T2, None), "b": (1, T2, T3, "disk"), "c": (0, None, T4, "early"), "d": (None, None, None, None),
    }


def test_strict_failure_marks_every_entry(ledger, events):
    assert _by_name(fv.apply_events(ledger, events, strict_reference=True)) == {
        "a": (1, T1, T3, "disk"), "b": (1, T2, T3, "disk"), "c": (0, None, T4, "disk"), "d": (1, None, T3, "disk"),
    }


def test_strict_without_failures(ledger, events):
    ok = events.where("event <> 'failed'")
    assert _by_name(fv.apply_events(ledger, ok, strict_reference=True)) == _by_name(fv.apply_events(ledger, ok))


def test_report_and_next(ledger, events):
    done = fv.apply_events(ledger, events)
    assert {r["dbName"]: r["Status"] for r in fv.ledger_report(done).collect()} == {
        "a": "Успешно", "b": "Ошибка", "c": "Успешно", "d": "Не обработано",
    }
    assert fv.next_pending(done).collect()[0]["dbName"] == "d"
    assert fv.next_pending(done.where("dbName <> 'd'")).isEmpty()


def test_pending_work_extends_the_ledger(spark, ledger):
    catalog = spark.createDataFrame(
        [(2, "model", "ONLINE"), (5, "a", "ONLINE"), (6, "new", "ONLINE"), (7, "off", "OFFLINE"), (8, "toolbox", "ONLINE"),
         (9, None, "ONLINE")],
        fv.RELATIONS["databases"],
    )
    pending = fv.pending_work(catalog, ledger, exclude=["toolbox"])
    assert [r["name"] for r in pending.collect()] == ["new"]
    commands = fv.render(pending.withColumnRenamed("name", "dbName"), {"backup_command": "backup {dbName}"})
    grown = fv.extend_ledger(ledger, commands, created=T4)
    assert grown.columns == ledger.columns and grown.count() == 5
    new = grown.where("dbName = 'new'").first()
    assert (new["backup_command"], new["processed"], new["creation_dt"]) == ("backup new", None, T4)
