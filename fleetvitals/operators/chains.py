"""Chains of sessions that block one another."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.functions import scope_of
from fleetvitals.plans import durable

ARROW = " -> "


def blocking_edges(snapshot: DataFrame) -> DataFrame:
    """Distinct (session, blocker) pairs of a lock snapshot."""
    return snapshot.select(*scope_of(snapshot), "session_id", "blocking_session_id").distinct()


def blocking_chains(snapshot: DataFrame, depth: str = "reference") -> DataFrame:
    """Blocking chains of the sessions of a snapshot.

    ``'reference'``: at most grandparent, parent and session, for sessions whose blocker has a lock row.
    ``'full'``: the path from the root blocker for every session, see ``full_chains``.
    """
    if depth == "reference":
        return _short_chains(snapshot)
    if depth == "full":
        return full_chains(blocking_edges(snapshot))
    raise ValueError("depth must be 'reference' or 'full'")


def _short_chains(snapshot: DataFrame) -> DataFrame:
    edges = blocking_edges(snapshot)
    scope = scope_of(edges)
    above = edges.select(
        *scope, F.col("session_id").alias("blocking_session_id"), F.col("blocking_session_id").alias("_above")
    )
    prefix = F.coalesce(F.concat(F.col("_above").cast("string"), F.lit(ARROW)), F.lit(""))
    chain = F.concat(prefix, F.col("blocking_session_id").cast("string"))
    chains = (
        edges.join(above, [*scope, "blocking_session_id"])
        .select(*scope, "session_id", chain.alias("_chain"))
        .groupBy(*scope, "session_id")
        .agg(F.min("_chain").alias("_chain"))
    )
    return chains.orderBy(*scope, "_chain", "session_id").select(
        *scope, "session_id", F.concat("_chain", F.lit(ARROW), F.col("session_id").cast("string")).alias("blocking_chain")
    )


def full_chains(edges: DataFrame) -> DataFrame:
    """Root-to-session path of every session, its length and whether it runs into a cycle.

    A blocker id of NULL or 0 means not blocked; of several blockers of a session the lowest is followed.
    A blocker without a row of its own ends the path as its root.  On a cycle the path holds each session
    once and starts with the last one reached before the repeat.

    Paths are doubled: in each round a session appends the path found so far by the session its own path
    ends at.  A chain of depth d is complete after about log2(d) rounds, and finished sessions only serve
    as lookups from then on.  Every round is checkpointed.
    """
    scope = scope_of(edges)
    blocker = F.when(F.col("blocking_session_id") != 0, F.col("blocking_session_id"))
    start = edges.groupBy(*scope, "session_id").agg(F.min(blocker).alias("_next"))
    # _path runs upwards from the session; _next is the session to visit next, NULL at the end
    paths = durable(
        start.select(
            *scope,
            "session_id",
            F.array("session_id").alias("_path"),
            "_next",
            F.lit(False).alias("_cycle"),
        )
    )
    done = [paths.where(F.col("_next").isNull())]
    active = paths.where(F.col("_next").isNotNull())
    lookup = paths
    while not active.isEmpty():
        found = lookup.select(
            *scope,
            F.col("session_id").alias("_next"),
            F.lit(True).alias("_known"),
            F.col("_path").alias("_more"),
            F.col("_next").alias("_then"),
            F.col("_cycle").alias("_loops"),
        )
        met = active.join(found, [*scope, "_next"], "left")
        known = F.col("_known").isNotNull()
        repeats = known & F.arrays_overlap("_path", "_more")
        cycle = F.coalesce(repeats | F.col("_loops"), F.lit(False))
        longer = F.when(known, F.array_distinct(F.concat("_path", "_more"))).otherwise(
            F.concat("_path", F.array("_next"))
        )
        stepped = durable(
            met.select(
                *scope,
                "session_id",
                longer.alias("_path"),
                F.when(known & ~cycle, F.col("_then")).alias("_next"),
                cycle.alias("_cycle"),
            )
        )
        done.append(stepped.where(F.col("_next").isNull()))
        active = stepped.where(F.col("_next").isNotNull())
        lookup = active
        for part in done:
            lookup = lookup.unionByName(part)
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    shown = F.array_join(F.transform(F.reverse("_path"), lambda s: s.cast("string")), ARROW)
    return result.select(
        *scope,
        "session_id",
        shown.alias("blocking_chain"),
        F.size("_path").alias("chain_length"),
        F.element_at("_path", -1).alias("root_session_id"),
        F.col("_cycle").alias("has_cycle"),
    )


def _joined_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _ends(nodes: DataFrame, scope: list[str]) -> tuple[DataFrame, DataFrame]:
    """Where the pointers of ``nodes`` (session_id, _next) end, and what goes round in circles.

    First frame: nodes that reach one without a pointer, with it (``_at``), and the ``_steps`` to it.  Second frame: the
    others, ``_at`` being the node ``_steps`` further on and ``_low`` the least id of the nodes passed.

    In each round a node takes over the pointer of the node its own points to.  Depths along a path have no gaps, so
    a round in which no node ends is the last one that could have ended any.
    """
    first = F.coalesce("_next", "session_id").alias("_at")
    low = F.least("session_id", F.coalesce("_next", "session_id")).alias("_low")
    moving = F.col("_next").isNotNull()
    start = durable(nodes.select(*scope, "session_id", first, moving.cast("bigint").alias("_steps"), low, (~moving).alias("_done")))
    done, active = [start.where("_done")], start.where("NOT _done")
    left = active.count()
    while left:
        known = _joined_all([*done, active]).select(
            *scope, F.col("session_id").alias("_at"), F.col("_at").alias("_to"), F.col("_steps").alias("_more"), F.col("_low").alias("_least"), F.col("_done").alias("_ends")
        )
        stepped = durable(
            active.join(known, [*scope, "_at"]).select(
                *scope,
                "session_id",
                F.col("_to").alias("_at"),
                (F.col("_steps") + F.col("_more")).alias("_steps"),
                F.least("_low", "_least").alias("_low"),
                F.col("_ends").alias("_done"),
            )
        )
        done.append(stepped.where("_done"))
        active, before = stepped.where("NOT _done"), left
        left = active.count()
        if left == before:
            break
    return _joined_all(done), active


def chain_roots(edges: DataFrame) -> DataFrame:
    """Where the blocking chain of every session leads, in one row per session: no paths are stored.

    ``blocking_session_id`` (the lowest, if there are several), ``root_session_id``, ``chain_length`` (sessions on the path, both
    ends included) and ``cycle_id``, the least session of the cycle that the chain runs into, or NULL.  Roots and
    lengths are those of ``full_chains``: on a cycle a chain holds each session once, and its root is the one before
    the repeat.  A path is its session followed by the path of the blocker, so following the column gives it
    (``expand_chains``); rows and state are linear in the sessions, whatever the depth.

    Pointers are doubled, each round checkpointed: about log2(depth) rounds, and for chains that run into cycles
    log2 of their number.  After that many steps every such chain stands on its cycle, and all of the cycle is
    reached; distances to it are then found by the same doubling, with the sessions of the cycle as ends.
    """
    scope = scope_of(edges)
    key = [*scope, "session_id"]
    blocker = F.when(F.col("blocking_session_id") != 0, F.col("blocking_session_id"))
    own = durable(edges.groupBy(*key).agg(F.min(blocker).alias("_next")))
    # blockers without a row of their own end a path
    outside = own.where("_next IS NOT NULL").select(*scope, F.col("_next").alias("session_id")).distinct().join(own.select(*key), key, "left_anti")
    nodes = durable(own.unionByName(outside.withColumn("_next", F.lit(None).cast(dict(own.dtypes)["_next"]))))
    ended, turning = _ends(nodes, scope)
    plain = ended.select(*key, F.col("_at").alias("root_session_id"), (F.col("_steps") + 1).alias("chain_length"), F.lit(None).cast("bigint").alias("cycle_id"))
    result = own.join(plain, key)
    if not turning.isEmpty():
        size, reach = turning.count(), 1
        state = durable(nodes.join(turning.select(*key), key, "left_semi").select(*key, F.col("_next").alias("_at"), F.least("session_id", "_next").alias("_low")))
        while reach < size:
            known = state.select(*scope, F.col("session_id").alias("_at"), F.col("_at").alias("_to"), F.col("_low").alias("_least"))
            state = durable(state.join(known, [*scope, "_at"]).select(*key, F.col("_to").alias("_at"), F.least("_low", "_least").alias("_low")))
            reach *= 2
        circle = state.select(*scope, F.col("_at").alias("session_id")).distinct()
        on_circle = durable(state.join(circle, key, "left_semi").select(*key, F.col("_low").alias("cycle_id")))
        lengths = on_circle.groupBy(*scope, "cycle_id").agg(F.count(F.lit(1)).alias("_around"))
        inside = nodes.join(turning.select(*key), key, "left_semi")
        cut = inside.join(on_circle.select(*key, F.lit(True).alias("_stop")), key, "left").select(
            *key, F.when(F.col("_stop").isNull(), F.col("_next")).alias("_next")
        )
        entered, _ = _ends(cut, scope)
        # the session of the cycle that points to where the chain enters
        before = inside.join(on_circle, key).select(*scope, F.col("_next").alias("_at"), F.col("session_id").alias("root_session_id"), "cycle_id")
        round_ = entered.select(*key, "_at", "_steps").join(before, [*scope, "_at"]).join(lengths, [*scope, "cycle_id"])
        looped = round_.select(*key, "root_session_id", (F.col("_steps") + F.col("_around")).alias("chain_length"), F.col("cycle_id").cast("bigint").alias("cycle_id"))
        result = result.unionByName(own.join(looped, key))
    return result.select(*key, F.col("_next").alias("blocking_session_id"), "root_session_id", "chain_length", "cycle_id")


def expand_chains(roots: DataFrame, sessions: DataFrame) -> DataFrame:
    """The paths of some ``sessions`` as rows: ``session_id``, ``step`` (0 is the session itself) and ``on_path``.

    The known part of every path doubles in each round: its rows are repeated as many steps further up by
    pointers over that many steps, which double too.
    """
    scope = scope_of(roots, sessions)
    lengths = sessions.select(*scope, "session_id").distinct().join(roots.select(*scope, "session_id", "chain_length"), [*scope, "session_id"])
    paths = durable(lengths.withColumns({"step": F.lit(0).cast("bigint"), "on_path": F.col("session_id")}))
    jump = roots.where("blocking_session_id IS NOT NULL").select(*scope, F.col("session_id").alias("on_path"), F.col("blocking_session_id").alias("_up"))
    reach, most = 1, paths.agg(F.max("chain_length")).first()[0] or 0
    while reach < most:
        onward = paths.where(F.col("step") + reach < F.col("chain_length")).join(jump, [*scope, "on_path"])
        paths = durable(paths.unionByName(onward.withColumns({"on_path": F.col("_up"), "step": F.col("step") + reach}).drop("_up")))
        reach *= 2
        if reach < most:
            further = jump.select(*scope, F.col("on_path").alias("_up"), F.col("_up").alias("_further"))
            jump = durable(jump.join(further, [*scope, "_up"]).select(*scope, "on_path", F.col("_further").alias("_up")))
    return paths.select(*scope, "session_id", "step", "on_path")
