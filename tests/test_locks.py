import itertools
import random
import re
import warnings
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import fleetvitals as fv
from fleetvitals import tune
from fleetvitals.operators import locks
from fleetvitals.operators.locks import PAIR_COLUMNS, SNAPSHOT_COLUMNS
from fleetvitals.plans import skew

SNAP = (
    "db_name string, resource_type string, resource_description string, hobt_id long, object_name string,"
    "request_type string, request_status string, request_mode string, session_id long, login_name string,"
    "host_name string, status string, open_transaction_count int, blocking_session_id long, transaction_il int, text string"
)


def _random_rows(seed, n=120, sessions=9):
    draw = random.Random(seed)
    blocker = {s: draw.choice([None, 0, *range(1, sessions + 1)]) for s in range(1, sessions + 1)}
    rows = []
    for _ in range(n):
        s = draw.randrange(1, sessions + 1)
        # two thirds of the rows are about one resource
        hobt = draw.choice([1, 1, 1, 1, 2, 3])
        rows.append(
            (
                draw.choice(["d1", "d1", "d1", "d2"]),
                draw.choice(["OBJECT", "PAGE", "KEY"]),
                draw.choice(["r1", "r1", "r1", None]),
                hobt,
                None if hobt == 3 else f"o{hobt}",
                "LOCK",
                draw.choice(["GRANT", "GRANT", "WAIT", "CONVERT"]),
                draw.choice(["S", "X", "IX"]),
                s,
                f"login{s % 3}" if s != 5 else None,
                "host",
                "sleeping",
                s % 2,
                blocker[s],
                2,
                f"text {s}",
            )
        )
    return rows


def _brute_pairs(rows, by, db=None, spid=None, login=None):
    names = SNAPSHOT_COLUMNS
    out = []
    for g, w in itertools.product([dict(zip(names, r, strict=True)) for r in rows], repeat=2):
        keys = ("db_name", "hobt_id", "object_name", "resource_description")
        if any(g[k] is None or g[k] != w[k] for k in keys) or g["session_id"] == w["session_id"]:
            continue
        if by == "resource" and not (g["request_status"] == "GRANT" and w["request_status"] != "GRANT"):
            continue
        if by == "blocker" and g["session_id"] != w["blocking_session_id"]:
            continue
        if db is not None and g["db_name"] != db:
            continue
        if spid is not None and spid not in (g["session_id"], w["session_id"]):
            continue
        if login is not None and login not in (g["login_name"], w["login_name"]):
            continue
        out.append(
            (g["db_name"], g["resource_type"], g["object_name"], g["resource_description"], g["request_mode"],
             g["request_status"], g["session_id"], g["login_name"], g["host_name"], g["text"], g["status"],
             g["open_transaction_count"], w["request_mode"], w["session_id"], w["login_name"], w["host_name"],
             w["blocking_session_id"], w["text"], w["open_transaction_count"])
        )
    return out


FILTERS = [{}, {"db_name": "d1"}, {"spid": 3}, {"login": "login1"}, {"spid": 3, "login": "login1"}, {"db_name": "d2", "spid": 4}]


@pytest.mark.parametrize("by", ["resource", "blocker"])
@pytest.mark.parametrize("wanted", FILTERS)
def test_pairs_and_contention_match_brute_force(spark, by, wanted):
    for seed in (1, 2):
        data = _random_rows(seed)
        snapshot = spark.createDataFrame(data, SNAP)
        brute = _brute_pairs(data, by, wanted.get("db_name"), wanted.get("spid"), wanted.get("login"))
        pairs = fv.wait_pairs(snapshot, by, **wanted)
        assert tuple(pairs.columns) == PAIR_COLUMNS
        assert Counter(map(tuple, pairs.collect())) == Counter(brute)
        parties = fv.contention(snapshot, by, **wanted)
        assert Counter(map(tuple, parties.holders.collect())) == Counter({(p[6], p[2], p[1], p[3]) for p in brute})
        assert Counter(map(tuple, parties.waiters.collect())) == Counter({(p[13], p[2], p[1], p[3]) for p in brute})


def test_pairs_stay_within_server_and_capture(spark):
    data = [("s1", 1, *r) for r in _random_rows(3)] + [("s2", 1, *r) for r in _random_rows(4)]
    snapshot = spark.createDataFrame(data, "server_id string, captured_at int, " + SNAP)
    brute = [("s1", 1, *p) for p in _brute_pairs(_random_rows(3), "resource")]
    brute += [("s2", 1, *p) for p in _brute_pairs(_random_rows(4), "resource")]
    assert Counter(map(tuple, fv.wait_pairs(snapshot, "resource").collect())) == Counter(brute)
    sessions = fv.session_overview(snapshot, fv.contention(snapshot).holders, snapshot.select("session_id").limit(0))
    assert {r["server_id"] for r in sessions.collect()} == {"s1", "s2"}


@pytest.mark.parametrize("block_rows", [1, 7, 1000])
def test_block_join_equals_plain_join(spark, block_rows):
    draw = random.Random(block_rows)
    left = spark.createDataFrame([(draw.choice([1, 1, 1, 2, 3, None]), i // 2) for i in range(80)], "k int, a int")
    right = spark.createDataFrame([(draw.choice([1, 1, 2, 4, None]), i // 3) for i in range(60)], "k int, b int")
    got = fv.block_join(left, right, ["k"], block_rows)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right, "k").collect()))


def test_block_join_copies_are_bounded(spark):
    """Many more blocks than tasks: rows are copied by the number of tasks, not by the rows of the other side."""
    left = spark.range(900).select((F.col("id") % 3).alias("k"), F.col("id").alias("a"))
    right = spark.range(600).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pieces = skew._hot_keys(left, right, ["k"], 3).collect()
    assert len(pieces) == 3
    assert all(1 <= p["_l"] <= tasks and 1 <= p["_r"] <= tasks and p["_l"] * p["_r"] <= 4 * tasks for p in pieces)
    got = fv.block_join(left, right, ["k"], 3)
    assert got.count() == got.distinct().count() == 3 * 300 * 200
    # neither side with its copies is held in memory as a whole
    assert "SortMergeJoin [k" in got._jdf.queryExecution().executedPlan().toString()


def test_block_join_pairs_come_in_tiles(spark):
    """Both values of nearly every pair were among the last few hundred rows, so files of pairs stay small."""
    left = spark.range(900).select(F.lit(1).alias("k"), F.col("id").alias("a"))
    right = spark.range(800).select(F.lit(1).alias("k"), F.col("id").alias("b"))
    got = fv.block_join(left, right, ["k"], 500).select("a", "b", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    for side in ("a", "b"):
        since = F.col("at") - F.lag("at").over(Window.partitionBy("part", side).orderBy("at"))
        near, pairs = got.select(since.alias("since")).agg(F.count_if(F.col("since") <= 256), F.count(F.lit(1))).first()
        assert pairs == 900 * 800
        assert near > 0.99 * pairs


def test_block_join_tiles_are_bounded(spark):
    """Rows that are all alike make no larger array than others, and none is lost."""
    side = spark.range(0, 1000, 1, 3).select(F.lit("x").alias("a"), F.lit(1).alias("k"), F.lit(None).cast("int").alias("n"))
    sizes = [len(r["_tile"]) for r in skew._tiled(side, ["k"]).collect()]
    assert max(sizes) <= skew.TILE_ROWS and sum(sizes) == 1000
    right = spark.createDataFrame([(7, 1), (8, 1), (9, 2)], "b int, k int")
    got = fv.block_join(side, right, ["k"], 300)
    assert got.schema == side.join(right, ["k"]).schema
    assert Counter(map(tuple, got.collect())) == {(1, "x", None, 7): 1000, (1, "x", None, 8): 1000}
    # a side may have no columns but its keys
    assert Counter(map(tuple, fv.block_join(side.select("k"), right, ["k"], 300).collect())) == {(1, 7): 1000, (1, 8): 1000}
    assert Counter(map(tuple, fv.block_join(side, right.select("k"), ["k"], 300).collect())) == {(1, "x", None): 2000}


def test_block_join_without_hot_keys_is_plain(spark):
    left = spark.createDataFrame([(1, 2), (2, 3)], "k int, a int")
    right = spark.createDataFrame([(1, 5), (1, 6)], "k int, b int")
    got = fv.block_join(left, right, ["k"])
    assert "_l_at" not in got._jdf.queryExecution().toString()
    assert Counter(map(tuple, got.collect())) == {(1, 2, 5): 1, (1, 2, 6): 1}


@pytest.mark.parametrize("listed", [0, 5_000_000])
def test_rows_in_pairs(spark, monkeypatch, listed):
    """The rows that pairs by blocker are made of, also with blocker ids of another type and keys too many to send."""
    monkeypatch.setattr(locks, "KEYS_IN_MEMORY", listed)
    data = _random_rows(5)
    snapshot = spark.createDataFrame(data, SNAP).withColumn("blocking_session_id", F.col("blocking_session_id").cast("int"))
    brute = Counter(_brute_pairs(data, "blocker"))
    kept = locks._in_pairs(snapshot)
    assert 0 < kept.count() < snapshot.count() and kept.exceptAll(snapshot).isEmpty()
    assert Counter(map(tuple, fv.wait_pairs(kept, "blocker").collect())) == brute
    assert Counter(map(tuple, fv.wait_pairs(snapshot, "blocker").collect())) == brute


def test_classes_take_one_shuffle_a_side(spark):
    """All groupings and joins by resource use the rows as they were dealt by resource once."""
    tune(spark, subset_joins=True)
    snapshot = spark.createDataFrame(_random_rows(6), SNAP)
    plan = fv.wait_classes(snapshot, "resource")._jdf.queryExecution().executedPlan().toString()
    tune(spark)
    assert "Exchange hashpartitioning" in plan and "ENSURE_REQUIREMENTS" not in plan


def test_report_order_of_pairs(spark):
    data = _random_rows(1)
    got = fv.wait_pair_report(fv.wait_pairs(spark.createDataFrame(data, SNAP), "resource"), "resource").collect()
    per_waiter = Counter(r["waiting_SPID"] for r in got)
    rank = {"OBJECT": 1, "EXTENT": 2, "PAGE": 3}
    key = [
        (r["db_name"], -per_waiter[r["waiting_SPID"]], r["locked_object_name"], rank.get(r["resource_type"], 4), r["granted_SPID"])
        for r in got
    ]
    assert key == sorted(key) and len(got) == len(_brute_pairs(data, "resource"))


@pytest.mark.parametrize("seed", [1, 2])
def test_details_match_brute_force(spark, seed):
    data = _random_rows(seed)
    snapshot = spark.createDataFrame(data, SNAP)
    brute = _brute_pairs(data, "blocker")
    holding, waiting = {p[6] for p in brute}, {p[13] for p in brute}
    held = {(p[6], p[2], p[1], p[3]) for p in brute}
    waited = {(p[13], p[2], p[1], p[3]) for p in brute}
    parties = fv.contention(snapshot)
    cases = [
        (fv.head_blockers, holding - waiting, held),
        (fv.mid_blockers, holding & waiting, held),
        (fv.leaf_waiters, waiting - holding, waited),
    ]
    for report, sessions, resources in cases:
        expected, once = Counter(), Counter()
        for row in data:
            r = dict(zip(SNAPSHOT_COLUMNS, row, strict=True))
            if r["session_id"] not in sessions:
                continue
            own = (r["session_id"], r["object_name"], r["resource_type"], r["resource_description"])
            mine = [c for c in resources if c[0] == r["session_id"]]
            status = r["request_status"] if r["request_status"] == "GRANT" or report is fv.head_blockers else f"___{r['request_status']}___"
            marked = f"___{r['object_name']}___"
            for c in mine:
                expected[(r["session_id"], marked if c == own and None not in c else r["object_name"], status)] += 1
            once[(r["session_id"], marked if own in mine and None not in own else r["object_name"], status)] += 1
        for flag, wanted in ((False, expected), (True, once)):
            got = report(snapshot, parties, once=flag).select("session_id", "object_name", "request_status").collect()
            assert Counter(map(tuple, got)) == wanted
    # the three sets of sessions are what they should be
    assert holding and waiting


def test_details_order(spark):
    snapshot = spark.createDataFrame(_random_rows(1), SNAP)
    got = fv.mid_blockers(snapshot, fv.contention(snapshot)).collect()
    key = [(r["session_id"], r["db_name"], (r["object_name"] or "").strip("_")) for r in got]
    assert key == sorted(key)


def _snap_row(**changes):
    base = dict(
        db_name="d", resource_type="OBJECT", resource_description="r", hobt_id=1, object_name="o", request_type="LOCK",
        request_status="GRANT", request_mode="S", session_id=1, login_name="l", host_name="h", status="Sleeping",
        open_transaction_count=0, blocking_session_id=None, transaction_il=2, text="t",
    )
    return tuple({**base, **changes}[c] for c in SNAPSHOT_COLUMNS)


def test_session_overview(spark):
    snapshot = spark.createDataFrame(
        [
            _snap_row(),
            _snap_row(object_name="p", db_name="e"),
            _snap_row(object_name="p", request_mode="IX"),
            _snap_row(object_name="q", request_status="WAIT"),
            _snap_row(object_name=None, request_status="CONVERT"),
            _snap_row(session_id=2, request_status="WAIT", transaction_il=9, status="sleeping"),
            _snap_row(session_id=3, transaction_il=2, blocking_session_id=7),
        ],
        SNAP,
    )
    tx = spark.createDataFrame([(3,), (3,)], "session_id long")
    holders = spark.createDataFrame([(3,), (3,)], "session_id long")
    got = {r["session_id"]: r for r in fv.session_overview(snapshot, holders, tx).collect()}
    one = got[1]
    assert one["status"] == "SLEEPING" and got[2]["status"] == "sleeping"
    assert (one["locks_in_dbs"], one["granted_locks"], one["waiting_locks"]) == (2, 3, 2)
    assert (one["objects_with_granted_locks"], one["objects_with_waiting_locks"], one["nonintent_objects_granted_locks"]) == (2, 1, 2)
    assert [got[s]["isolation_level"] for s in (1, 2, 3)] == ["Read Committed", "UNKNOWN", "Read Committed Snapshot"]
    assert [got[s]["blocker_mark"] for s in (1, 2, 3)] == ["", "", "V"]
    strict = fv.session_overview(snapshot, holders, tx, strict_reference=True).collect()
    assert [r["session_id"] for r in strict] == [3, 1, 2]
    assert {r["isolation_level"] for r in strict if r["session_id"] in (1, 3)} == {"Read Committed Snapshot"}
    assert [r["session_id"] for r in fv.session_overview(snapshot, holders, tx, spid=2).collect()] == [2]
    assert fv.session_overview(snapshot, holders, tx, db_name="e").first()["granted_locks"] == 1


def test_object_overview(spark):
    snapshot = spark.createDataFrame(
        [
            _snap_row(),
            _snap_row(session_id=2, request_status="WAIT", resource_type="KEY"),
            _snap_row(session_id=2, request_status="WAIT", resource_type="PAGE"),
            _snap_row(object_name=None),
        ],
        SNAP,
    )
    first, second = fv.object_overview(snapshot).collect()
    assert (first["object_name"], first["overall_locks"], first["sessions_with_granted_locks"], first["waiting_sessions"]) == ("o", 3, 1, 1)
    assert (first["key_locks_waiting"], first["page_locks_waiting"], first["object_nonintent_locks_granted"]) == (1, 1, 1)
    assert first["key_locks_pctg"] == Decimal("33.33") and first["tbl_locks_in_db_pctg"] == Decimal("75.00")
    assert second["object_name"] is None and second["tbl_locks_in_db_pctg"] == Decimal("25.00")


@pytest.fixture
def inputs(spark):
    locks = [
        ("OBJECT", "", 100, 5, "LOCK", "GRANT", "S", 51),
        ("KEY", "k", 900, 5, "LOCK", "WAIT", "X", 52),
        ("KEY", "k", 901, 5, "LOCK", "WAIT", "X", 52),
        ("OBJECT", "", 404, 5, "LOCK", "GRANT", "S", 51),
        ("METADATA", "", 0, 5, "LOCK", "GRANT", "S", 51),
        ("APPLICATION", "", 0, 6, "LOCK", "GRANT", "S", 51),
        ("DATABASE", "", 0, 5, "LOCK", "GRANT", "S", 51),
        ("OBJECT", "", 100, 2, "LOCK", "GRANT", "S", 51),
        ("OBJECT", "", 100, 5, "LOCK", "GRANT", "S", 9),
        ("OBJECT", "", 100, 5, "LOCK", "GRANT", "S", 77),
    ]
    sessions = [
        (51, "ann", "h", "running", 1, 3, 1), (52, "bob", "h", "sleeping", 0, 4, 1), (9, "sys", "h", "running", 0, 1, 0),
    ]
    make = spark.createDataFrame
    return fv.LockInputs(
        make(locks, fv.RELATIONS["tran_locks"]),
        make(sessions, fv.RELATIONS["sessions"]),
        make([(51, bytearray(b"\x01")), (52, bytearray(b"\x02"))], fv.RELATIONS["connections"]),
        make([(52, 51, 2)], fv.RELATIONS["requests"]),
        make([(bytearray(b"\x01"), "select 1", None)], fv.RELATIONS["sql_text"]),
        make([(5, "shop", "ONLINE"), (2, "tempdb", "ONLINE")], fv.RELATIONS["databases"]),
        make([(5, 100, 900)], "database_id int, object_id long, hobt_id long"),
        make([(5, 100, "orders"), (2, 100, "temp")], "database_id int, object_id long, name string"),
    )


def test_lock_snapshot(inputs):
    got = {(r["resource_type"], r["hobt_id"]): r for r in fv.lock_snapshot(inputs).collect()}
    assert {k: v["object_name"] for k, v in got.items()} == {
        ("OBJECT", 100): "orders", ("KEY", 900): "orders", ("KEY", 901): "HOBT: 901", ("OBJECT", 404): "OBJECT: 404",
        ("METADATA", 0): "METADATA", ("APPLICATION", 0): "unknown",
    }
    assert got[("APPLICATION", 0)]["db_name"] == "NULL" and got[("KEY", 900)]["db_name"] == "shop"
    key = got[("KEY", 900)]
    assert (key["session_id"], key["blocking_session_id"], key["transaction_il"], key["text"]) == (52, 51, 2, None)
    assert got[("OBJECT", 100)]["transaction_il"] == 3 and got[("OBJECT", 100)]["text"] == "select 1"


def test_lock_rows_meet_names_without_copies_of_their_columns(inputs):
    """What is shuffled for the names are the lock rows as they are."""
    named = fv.resolve_names(inputs.locks, inputs.partitions, inputs.objects)
    plan = named._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"resource_(associated_entity|database)_id#\d+L? AS ", plan)
    assert {r["object_name"] for r in named.where("resource_type = 'KEY'").collect()} == {"orders", "HOBT: 901"}


def test_lock_rows_meet_sessions_with_their_words_as_a_number(spark, inputs):
    """Words go to the sessions as a number; words out of the list, and none, come through as they are."""
    odd = [("XACT", "LOCK", "WAIT", "RangeX_X"), ("NEW", "LOCK", "GRANT", "S"), ("KEY", None, "GRANT", "S"), ("KEY", "LOCK", "grant", "IX"), ("FILE", "LOCK", None, None)]
    words = ["resource_type", "request_type", "request_status", "request_mode"]
    rows = [dict(zip(words, w, strict=True)) | {"resource_associated_entity_id": n} for n, w in enumerate(odd)]
    like = inputs.locks.where("request_session_id = 51 and resource_database_id = 5").limit(1).drop(*words, "resource_associated_entity_id")
    made = spark.createDataFrame(rows, ", ".join(f"{w} string" for w in words) + ", resource_associated_entity_id long")
    snapshot = fv.lock_snapshot(inputs._replace(locks=like.crossJoin(made).select(*inputs.locks.columns)))
    assert sorted(((r["hobt_id"], *[r[w] for w in words]) for r in snapshot.collect()), key=repr) == [(n, *w) for n, w in enumerate(odd)]
    plan = fv.lock_snapshot(inputs)._jdf.queryExecution().optimizedPlan().toString()
    below = plan.split("Join Inner", 1)[1].split("Join", 1)[0]
    assert " AS _words#" in below


def test_lock_snapshot_scope_switches(inputs):
    count = lambda **flags: fv.lock_snapshot(inputs, **flags).count()
    assert (count(), count(system_databases=True), count(system_sessions=True), count(own_session_id=51)) == (6, 7, 7, 2)
    strict = fv.lock_snapshot(inputs, strict_reference=True).where("hobt_id in (901, 404)")
    assert {r["object_name"] for r in strict.collect()} == {None}


def test_session_locks_and_blocked_by(inputs):
    got = [tuple(r) for r in fv.session_locks(inputs.locks, inputs.partitions, inputs.objects, 52).collect()]
    assert got == [(52, "X", "WAIT", None, "KEY", 1), (52, "X", "WAIT", "orders", "KEY", 1)]
    assert [tuple(r) for r in fv.blocked_by(inputs.requests, 51).collect()] == [(51, 1, 52)]
    assert fv.blocked_by(inputs.requests, 52).isEmpty()
    report = fv.lock_report(inputs.locks, inputs.requests, inputs.partitions, inputs.objects, 51)
    assert report["blocked"].first()["min_blocked_session_id"] == 52
    assert {r["session_id"] for r in report["locks"].collect()} == {51}
    assert {r["session_id"] for r in report["blocked_locks"].collect()} == {52}
    quiet = fv.lock_report(inputs.locks, inputs.requests, inputs.partitions, inputs.objects, 52)
    assert quiet["blocked"].isEmpty() and quiet["blocked_locks"].isEmpty()


def test_locking_report(spark, inputs, tmp_path):
    tx = spark.createDataFrame([], "session_id long")
    path = str(tmp_path / "snapshot")
    report = fv.locking_report(inputs, tx, mode="DETAILED", chains=True, db_id=5, snapshot_path=path)
    assert set(report) == {
        "snapshot", "wait_pairs", "sessions", "objects", "head_blockers", "mid_blockers", "leaf_waiters", "blocking_chains",
    }
    assert {r["db_name"] for r in report["objects"].collect()} == {"shop"}
    empty = inputs._replace(locks=inputs.locks.limit(0))
    assert fv.locking_report(empty, tx, snapshot_path=path, refresh=False)["snapshot"].count() == 6
    assert fv.locking_report(empty, tx, snapshot_path=path)["snapshot"].count() == 0
    # an empty stored snapshot is refilled even when a refresh was not asked for
    assert fv.locking_report(inputs, tx, snapshot_path=path, refresh=False)["snapshot"].count() == 6
    with warnings.catch_warnings(record=True) as raised:
        warnings.simplefilter("always")
        plain = fv.locking_report(inputs, tx, mode="EVERYTHING")
    assert len(raised) == 1 and set(plain) == {"snapshot", "wait_pairs", "sessions", "objects"}
    fv.release(plain["snapshot"])
    with pytest.raises(ValueError):
        fv.locking_report(inputs, tx, db_name="nowhere")
    with pytest.raises(ValueError):
        fv.locking_report(inputs, tx, db_name="shop", db_id=2)


@pytest.mark.parametrize("by", ["resource", "blocker"])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_hold_all_pairs(spark, by, seed):
    data = _random_rows(seed)
    snapshot = spark.createDataFrame(data, SNAP)
    brute = _brute_pairs(data, by)
    # database, object, resource, type, modes and status of a pair
    place = lambda p: (p[0], p[2], p[3], p[1], p[4], p[5], p[12])
    wanted, per_session = Counter(map(place, brute)), Counter(p[13] for p in brute)
    got = Counter()
    classes = fv.wait_classes(snapshot, by).collect()
    for r in classes:
        got[(r["db_name"], r["locked_object_name"], r["resource"], r["resource_type"], r["lock_mode"], r["lock_status"], r["waiting_lock_mode"])] += r["pairs"]
        assert 0 < r["pairs"] <= r["holders"] * r["waiters"]
    assert got == wanted
    assert {r["waiting_SPID"]: r["pairs"] for r in fv.waiting_sessions(snapshot, by).collect()} == per_session
    report = fv.wait_pair_report(fv.wait_pairs(snapshot, by), by, fv.waiting_sessions(snapshot, by)).collect()
    assert report == fv.wait_pair_report(fv.wait_pairs(snapshot, by), by).collect()


def test_classes_of_a_hot_resource_stay_few(spark):
    """Thousands of holders and waiters on one resource are millions of pairs and a handful of classes."""
    ids = spark.range(6000).selectExpr(
        "'d' db_name", "'OBJECT' resource_type", "'r' resource_description", "7L hobt_id", "'o' object_name", "'LOCK' request_type",
        "IF(id % 2 = 0, 'GRANT', 'WAIT') request_status", "IF(id % 3 = 0, 'S', 'X') request_mode", "id session_id", "'l' login_name",
        "'h' host_name", "'running' status", "0 open_transaction_count", "CAST(NULL AS BIGINT) blocking_session_id", "2 transaction_il", "'t' text",
    )
    classes = fv.wait_classes(ids, "resource").collect()
    assert len(classes) == 4 and sum(r["pairs"] for r in classes) == 3000 * 3000
    details = fv.lock_details(ids, fv.contention(ids, "resource", stored=True))
    assert details.where("object_name = '___o___'").count() == 6000


def test_details_take_few_exchanges(spark):
    snapshot = fv.durable(spark.createDataFrame(_random_rows(4), SNAP))
    details = fv.lock_details(snapshot, fv.contention(snapshot, stored=True))
    details.collect()
    plan = details._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum(plan.count(f"{kind}Exchange") for kind in ("", "Broadcast")) <= 6 or plan.count("Exchange ") <= 6


def test_names_and_texts_key_no_shuffle_of_lock_rows(spark):
    """Only the row per session that carries the texts is made distinct by them."""
    snapshot = spark.createDataFrame(_random_rows(4), SNAP)
    marks = snapshot.select("session_id").limit(0)
    overview = fv.session_overview(snapshot, marks, marks)
    plan = overview._jdf.queryExecution().executedPlan().toString()
    keys = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert keys and sum("text#" in line.split("hashpartitioning")[1] for line in keys) <= 1
    assert not any("object_name#" in line.split("hashpartitioning")[1] for line in keys)


def test_report_table(spark, inputs):
    """Every section row by row in its order, whatever the mode."""
    tx = spark.createDataFrame([], "session_id long")
    report = fv.locking_report(inputs, tx, mode="DETAILED", chains=True)
    table = fv.report_table(report).collect()
    for section, frame in report.items():
        rows = sorted((r["row_number"], r["columns"]) for r in table if r["section"] == section)
        if section == "snapshot":
            assert not rows
            continue
        shown = [{c: None if v is None else str(v) for c, v in r.asDict().items()} for r in frame.collect()]
        assert [n for n, _ in rows] == list(range(1, len(shown) + 1))
        assert [columns for _, columns in rows] == shown
    only = fv.report_table(report, ["sessions"])
    assert {r["section"] for r in only.collect()} == {"sessions"}


def test_lock_reports_of_a_set(inputs):
    arguments = (inputs.locks, inputs.requests, inputs.partitions, inputs.objects)
    single = fv.lock_report(*arguments, 51)
    got = fv.lock_reports(*arguments).where("report_of = 51").collect()
    for section in ("locks", "blocked_locks"):
        mine = Counter(tuple(r)[2:] for r in got if r["section"] == section)
        assert mine == Counter(map(tuple, single[section].collect())) and mine
    quiet = inputs.requests.sparkSession.createDataFrame([(52,)], "session_id long")
    assert {(r["report_of"], r["section"]) for r in fv.lock_reports(*arguments, quiet).collect()} == {(52, "locks")}
