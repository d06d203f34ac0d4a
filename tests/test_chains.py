import random

import pytest

import fleetvitals as fv


def _edges(spark, pairs):
    return spark.createDataFrame(pairs, "session_id long, blocking_session_id long")


def _full(spark, pairs):
    return {r["session_id"]: tuple(r)[1:] for r in fv.blocking_chains(_edges(spark, pairs), "full").collect()}


def test_short_chains(spark):
    edges = _edges(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, 0), (6, 5), (7, 6), (8, 99), (3, 2)])
    got = {r["session_id"]: r["blocking_chain"] for r in fv.blocking_chains(edges).collect()}
    assert got == {2: "1 -> 2", 3: "1 -> 2 -> 3", 4: "2 -> 3 -> 4", 6: "0 -> 5 -> 6", 7: "5 -> 6 -> 7"}


def test_full_chains(spark):
    assert _full(spark, [(1, None), (2, 1), (3, 2), (4, 3), (5, 0), (6, 5), (8, 99), (9, 8)]) == {
        1: ("1", 1, 1, False),
        2: ("1 -> 2", 2, 1, False),
        3: ("1 -> 2 -> 3", 3, 1, False),
        4: ("1 -> 2 -> 3 -> 4", 4, 1, False),
        5: ("5", 1, 5, False),
        6: ("5 -> 6", 2, 5, False),
        8: ("99 -> 8", 2, 99, False),
        9: ("99 -> 8 -> 9", 3, 99, False),
    }


def test_cycles_end(spark):
    got = _full(spark, [(1, 1), (2, 1), (3, 5), (4, 3), (5, 4), (6, 5), (7, 6)])
    assert all(v[3] for v in got.values())
    assert got[1][0] == "1" and got[2][0] == "1 -> 2"
    assert got[3][0] == "4 -> 5 -> 3" and got[7][0] == "3 -> 4 -> 5 -> 6 -> 7"


def test_deep_chain_with_a_hot_root(spark):
    deep = [(i, i - 1 if i else None) for i in range(1, 201)]
    deep[0] = (1, None)
    wide = [(1000 + i, 1) for i in range(300)]
    got = _full(spark, deep + wide)
    assert got[200][:3] == (" -> ".join(map(str, range(1, 201))), 200, 1)
    assert sum(v[2] == 1 for v in got.values()) == 500


def test_several_blockers_follow_the_lowest(spark):
    assert _full(spark, [(1, None), (2, None), (3, 2), (3, 1), (3, None)])[3] == ("1 -> 3", 2, 1, False)


def test_unknown_depth(spark):
    with pytest.raises(ValueError):
        fv.blocking_chains(_edges(spark, [(1, None)]), "deep")


@pytest.mark.parametrize("seed", range(4))
def test_chain_roots_equal_full_chains(spark, seed):
    """Random pointers make trees, tails and cycles; paths that are followed are those that are stored."""
    draw = random.Random(seed)
    sessions = draw.sample(range(1, 200), 60)
    pairs = [(s, draw.choice([None, 0, *sessions, 500, 501]) if draw.random() < 0.9 else s) for s in sessions]
    pairs += [(s, draw.choice(sessions)) for s in sessions[:10]]
    edges = _edges(spark, pairs)
    full = _full(spark, pairs)
    roots = fv.chain_roots(edges)
    got = {r["session_id"]: r for r in roots.collect()}
    assert got.keys() == full.keys()
    paths = {}
    for r in fv.expand_chains(roots, edges.select("session_id")).collect():
        paths.setdefault(r["session_id"], {})[r["step"]] = r["on_path"]
    for session, (chain, length, root, looped) in full.items():
        r = got[session]
        assert (r["root_session_id"], r["chain_length"], r["cycle_id"] is not None) == (root, length, looped), session
        steps = paths[session]
        assert sorted(steps) == list(range(length))
        assert " -> ".join(str(steps[i]) for i in reversed(range(length))) == chain
        if looped:
            around, at = [], root
            while at not in around:
                around.append(at)
                at = got[at]["blocking_session_id"]
            assert r["cycle_id"] == min(around)


def test_chain_roots_of_nothing_and_of_one_circle(spark):
    assert fv.chain_roots(_edges(spark, [])).count() == 0
    ring = [(i, i % 37 + 1) for i in range(1, 38)]
    rows = fv.chain_roots(_edges(spark, ring)).collect()
    assert {(r["chain_length"], r["cycle_id"]) for r in rows} == {(37, 1)}
    assert {r["session_id"]: r["root_session_id"] for r in rows}[5] == 4
