"""Who holds which locks, who waits for whom."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetvitals.functions import CATALOG_SCOPE, half_up, scope_of
from fleetvitals.operators.chains import blocking_chains
from fleetvitals.operators.filters import LAST_SYSTEM_DATABASE, optional_filter, require_exists
from fleetvitals.plans import block_join, number_any, stored as stored_rows
from fleetvitals.sources import load_or_build

GRANTED = "GRANT"

# Resource types by how their object name is found (fixed values).
NAMED_BY_TYPE = ("DATABASE", "METADATA", "FILE")
NAMED_BY_PARTITION = ("EXTENT", "HOBT", "KEY", "PAGE", "RID")
ROW_LOCKS = ("KEY", "RID")

# The words that lock rows are made of (fixed values); others are kept as they are.
WORDS = {
    "resource_type": (
        *("DATABASE", "FILE", "OBJECT", "PAGE", "KEY", "EXTENT", "RID", "APPLICATION", "METADATA", "HOBT"),
        *("ALLOCATION_UNIT", "OIB", "ROWGROUP", "XACT"),
    ),
    "request_type": ("LOCK",),
    "request_status": ("GRANT", "CONVERT", "WAIT", "LOW_PRIORITY_CONVERT", "LOW_PRIORITY_WAIT", "ABORT_BLOCKERS"),
    "request_mode": (
        *("NULL", "Sch-S", "Sch-M", "S", "U", "X", "IS", "IU", "IX", "SIU", "SIX", "UIX", "BU", "RangeS_S", "RangeS_U"),
        *("RangeI_N", "RangeI_S", "RangeI_U", "RangeI_X", "RangeX_S", "RangeX_U", "RangeX_X"),
    ),
}

# Isolation level names by code (fixed values).
ISOLATION_LEVELS = {
    0: "Unspecified",
    1: "Read Uncommitted",
    2: "Read Committed",
    3: "Repeatable Read",
    4: "Serializable",
    5: "Snapshot",
}
SNAPSHOT_READS = "Read Committed Snapshot"

# What makes two lock rows be about the same resource.
RESOURCE = ("db_name", "hobt_id", "object_name", "resource_description")

SNAPSHOT_COLUMNS = (
    "db_name",
    "resource_type",
    "resource_description",
    "hobt_id",
    "object_name",
    "request_type",
    "request_status",
    "request_mode",
    "session_id",
    "login_name",
    "host_name",
    "status",
    "open_transaction_count",
    "blocking_session_id",
    "transaction_il",
    "text",
)

MODES = ("OVERVIEW", "DETAILED")


class LockInputs(NamedTuple):
    """The relations a lock snapshot is made from."""

    locks: DataFrame
    sessions: DataFrame
    connections: DataFrame
    requests: DataFrame
    sql_text: DataFrame
    databases: DataFrame
    partitions: DataFrame
    objects: DataFrame


def _type_rank() -> Column:
    kind = F.col("resource_type")
    return F.when(kind == "OBJECT", 1).when(kind == "EXTENT", 2).when(kind == "PAGE", 3).otherwise(4)


def _code(*columns: str) -> Column:
    """A number that stands for the values."""
    return F.xxhash64(*columns)


def _same(columns: Sequence[str]) -> Column:
    """Equality of columns with those named ``_of_`` them, NULL being a value."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return test


def _least(rows: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    """The least non-null ``name`` of every key, by rank: tasks cut their part to one row per key, and no text is aggregated."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.col(name).asc_nulls_last()))
    return rows.select(*key, name).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _is_granted() -> Column:
    return F.col("request_status") == GRANTED


def _is_waiting() -> Column:
    return F.col("request_status") != GRANTED


# ---------------------------------------------------------------------------------------------- snapshot


def resolve_names(locks: DataFrame, partitions: DataFrame, objects: DataFrame, fallback: bool = True) -> DataFrame:
    """Add ``object_name`` to lock rows.

    Object ids and partition ids go into one lookup keyed by (database, kind of id, id), so lock rows are
    joined once.  A lookup that finds nothing gives ``OBJECT: id`` or ``HOBT: id``; with
    ``fallback=False`` it gives NULL.
    """
    at = [*scope_of(partitions, objects), "database_id"]
    by_object = objects.select(*at, F.lit(True).alias("_by_object"), F.col("object_id").alias("_id"), "name")
    by_partition = partitions.join(objects.select(*at, "object_id", "name"), [*at, "object_id"]).select(
        *at, F.lit(False).alias("_by_object"), F.col("hobt_id").alias("_id"), "name"
    )
    scope = scope_of(locks, partitions, objects)
    key = [*scope, "database_id", "_by_object", "_id"]
    names = _least(by_object.unionByName(by_partition), key, "name")

    kind = F.col("resource_type")
    looked_up = (kind == "OBJECT") | kind.isin(*NAMED_BY_PARTITION)
    entity = F.col("resource_associated_entity_id")
    # lock rows are joined as they are: copies of their columns as keys would be shuffled with them
    names = names.select(*[F.col(c).alias(f"_of_{c}") for c in key], F.col("name").alias("_found"))
    own = {**{c: F.col(c) for c in scope}, "database_id": F.col("resource_database_id"), "_by_object": kind == "OBJECT", "_id": entity}
    met = reduce(lambda a, b: a & b, [value == F.col(f"_of_{c}") for c, value in own.items()])
    found = F.col("_found")
    if fallback:
        prefix = F.when(kind == "OBJECT", F.lit("OBJECT: ")).otherwise(F.lit("HOBT: "))
        found = F.coalesce(found, F.concat(prefix, entity.cast("string")))
    name = F.when(kind.isin(*NAMED_BY_TYPE), kind).when(looked_up, found).otherwise(F.lit("unknown"))
    return locks.join(names, met, "left").select(*locks.columns, name.alias("object_name"))


def session_profiles(
    sessions: DataFrame, connections: DataFrame, requests: DataFrame, sql_text: DataFrame
) -> DataFrame:
    """Sessions with their request state and last query text."""
    scope = scope_of(sessions)
    text_scope = scope_of(connections, sql_text)
    handles = sql_text.select(*text_scope, F.col("sql_handle").alias("most_recent_sql_handle"), "text")
    texts = _least(handles, [*text_scope, "most_recent_sql_handle"], "text")
    conn = connections.select(*scope_of(connections), "session_id", "most_recent_sql_handle").join(
        texts, [*text_scope, "most_recent_sql_handle"], "left"
    )
    reqs = requests.select(
        *scope_of(requests),
        "session_id",
        "blocking_session_id",
        F.col("transaction_isolation_level").alias("_request_il"),
    )
    return (
        sessions.join(conn, [*scope_of(sessions, conn), "session_id"], "left")
        .join(reqs, [*scope_of(sessions, reqs), "session_id"], "left")
        .select(
            *scope,
            "session_id",
            "login_name",
            "host_name",
            "status",
            "open_transaction_count",
            "blocking_session_id",
            F.coalesce("_request_il", "transaction_isolation_level").alias("transaction_il"),
            "text",
        )
    )


def _packed_words(rows: DataFrame) -> DataFrame:
    """Rows with the words of ``WORDS`` as one number, ``_words``: a column of words costs a shuffle more than its value.

    A row with any other word, or none, has no number and keeps its words.
    """
    known, number = F.lit(True), F.lit(0)
    for c, words in WORDS.items():
        known = known & F.col(c).isin(*words)
        at = F.array_position(F.array(*[F.lit(w) for w in words]), F.col(c)) - 1
        number = number * len(words) + at
    packed = rows.withColumn("_words", F.when(known, number))
    return packed.withColumns({c: F.when(F.col("_words").isNull(), F.col(c)) for c in WORDS})


def _unpacked_words(rows: DataFrame) -> DataFrame:
    """The words back in their columns."""
    number, shown = F.col("_words"), {}
    for c, words in reversed(WORDS.items()):
        # not element_at, which takes a null place for the last one
        word = F.get(F.array(*[F.lit(w) for w in words]), (number % len(words)).cast("int"))
        shown[c] = F.coalesce(word, F.col(c))
        number = F.floor(number / len(words))
    return rows.withColumns(shown).drop("_words")


def lock_snapshot(
    inputs: LockInputs,
    system_databases: bool = False,
    system_sessions: bool = False,
    own_session_id: int | None = None,
    strict_reference: bool = False,
) -> DataFrame:
    """One enriched row per lock request.

    Locks on databases themselves are left out, and so are those of system databases, system sessions and
    the caller's own session unless asked for.  Locks of a session that is not in ``sessions`` are dropped:
    the process test needs the session row.

    The session side is assembled first, so the lock rows take part in three joins: with sessions, with
    database names and with object names, each key-unique.  They go to the sessions with their fixed words as one number.
    """
    locks = inputs.locks.where(
        (F.col("resource_type") != "DATABASE")
        & (F.col("resource_database_id") > (0 if system_databases else LAST_SYSTEM_DATABASE))
    )
    if own_session_id is not None:
        locks = locks.where(F.col("request_session_id") != own_session_id)
    users = inputs.sessions.where(F.col("is_user_process") >= (0 if system_sessions else 1))
    profiles = session_profiles(users, inputs.connections, inputs.requests, inputs.sql_text)
    named = resolve_names(locks, inputs.partitions, inputs.objects, fallback=not strict_reference)

    db_scope = scope_of(named, inputs.databases)
    names = inputs.databases.select(
        *db_scope, F.col("database_id").alias("resource_database_id"), F.col("name").alias("_db")
    )
    met = _packed_words(named).withColumn("session_id", F.col("request_session_id")).join(profiles, [*scope_of(named, profiles), "session_id"])
    rows = (
        _unpacked_words(met)
        .join(names, [*db_scope, "resource_database_id"], "left")
        .withColumn("db_name", F.coalesce("_db", F.lit("NULL")))
        .withColumn("hobt_id", F.col("resource_associated_entity_id"))
    )
    return rows.select(*scope_of(inputs.locks), *SNAPSHOT_COLUMNS)


# ------------------------------------------------------------------------------------------- wait pairs

_HOLDER = {
    "resource_type": "resource_type",
    "request_mode": "lock_mode",
    "request_status": "lock_status",
    "session_id": "granted_SPID",
    "login_name": "login",
    "host_name": "host",
    "text": "locking_query",
    "status": "locking_session_status",
    "open_transaction_count": "tran_cnt",
}
_WAITER = {
    "request_mode": "waiting_lock_mode",
    "session_id": "waiting_SPID",
    "login_name": "waiting_login",
    "host_name": "waiting_host",
    "blocking_session_id": "waiter_blocking_session",
    "text": "waiting_query",
    "open_transaction_count": "waiter_tran_cnt",
}
PAIR_COLUMNS = (
    "db_name",
    "resource_type",
    "locked_object_name",
    "resource",
    "lock_mode",
    "lock_status",
    "granted_SPID",
    "login",
    "host",
    "locking_query",
    "locking_session_status",
    "tran_cnt",
    "waiting_lock_mode",
    "waiting_SPID",
    "waiting_login",
    "waiting_host",
    "waiter_blocking_session",
    "waiting_query",
    "waiter_tran_cnt",
)


def _check_by(by: str) -> None:
    if by not in ("resource", "blocker"):
        raise ValueError("by must be 'resource' or 'blocker'")


def _sides(snapshot: DataFrame, by: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows that can hold, rows that can wait, and the keys on which the two meet.

    By resource: granted rows meet other rows of the same resource.  By blocker: any row meets the rows of
    the same resource whose session names it as its blocker, whatever their status.
    """
    keys = [*scope_of(snapshot), *RESOURCE]
    if by == "resource":
        return snapshot.where(_is_granted()), snapshot.where(_is_waiting()), keys
    on = [*keys, "_link"]
    return *_meeting(*_linked(snapshot), on), on


# Lists of keys up to this long are sent to all tasks (about 250 MB as a hash table).
KEYS_IN_MEMORY = 5_000_000


def _linked(snapshot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with the session they hold for, and rows with the session they wait for, in ``_link``."""
    own, blocker = F.col("session_id"), F.col("blocking_session_id")
    types = dict(snapshot.dtypes)
    if types["session_id"] != types["blocking_session_id"]:
        # codes of one number differ by its type
        own, blocker = own.cast("bigint"), blocker.cast("bigint")
    return snapshot.withColumn("_link", own), snapshot.where(own != blocker).withColumn("_link", blocker)


def _listed(keys: DataFrame) -> DataFrame:
    """A list of keys, stored, and marked for broadcast when it is short."""
    kept = stored_rows(keys, "keys")
    return F.broadcast(kept) if kept.count() <= KEYS_IN_MEMORY else kept


def _met_codes(holders: DataFrame, waiters: DataFrame, on: Sequence[str]) -> DataFrame:
    """The 64-bit codes of the keys that are on both sides.

    Few rows of a session are about what another session waits for, so holders send only codes of sessions that
    somebody waits for.
    """
    blockers = _listed(waiters.select("_link").distinct())
    known = (holders.na.drop(subset=list(on)).join(blockers, "_link", "left_semi"), True), (waiters.na.drop(subset=list(on)), False)
    held, awaited = [side.select(_code(*on).alias("_met"), F.lit(holds).alias("_holds")) for side, holds in known]
    both = F.bool_or("_holds") & F.bool_or(~F.col("_holds"))
    return _listed(held.unionByName(awaited).groupBy("_met").agg(both.alias("_both")).where("_both").select("_met"))


def _meeting(holders: DataFrame, waiters: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides without rows that meet none of the other side, filtered where they lie by the list of codes.

    Rows with the code of another key stay; the join that follows drops them.
    """
    met = _met_codes(holders, waiters, on)
    return tuple(side.withColumn("_met", _code(*on)).join(met, "_met", "left_semi").drop("_met") for side in (holders, waiters))


def _in_pairs(snapshot: DataFrame) -> DataFrame:
    """The lock rows that can be in a wait pair by blocker, each once: all that reports on such pairs need to read."""
    on = [*scope_of(snapshot), *RESOURCE, "_link"]
    holders, waiters = _linked(snapshot)
    met = _met_codes(holders, waiters, on)
    waits = F.coalesce(F.col("session_id") != F.col("blocking_session_id"), F.lit(False))
    rows = holders.withColumn("_held", _code(*on))
    link = F.col("blocking_session_id").cast(dict(rows.dtypes)["_link"])
    rows = rows.withColumn("_link", link).withColumn("_awaited", F.when(waits, _code(*on)))
    for code in ("_held", "_awaited"):
        rows = rows.join(met.select(F.col("_met").alias(code), F.lit(True).alias(f"{code}_met")), code, "left")
    return rows.where("_held_met or _awaited_met").select(*snapshot.columns)


def wait_pairs(
    snapshot: DataFrame,
    by: str = "blocker",
    db_name: str | None = None,
    spid: int | None = None,
    login: str | None = None,
) -> DataFrame:
    """Every pair of a lock row and a row of another session that waits for it.

    A session or login filter keeps pairs with that session or login on either side; only resources it
    touches are then joined at all.  Hot resources are joined block by block (``block_join``).
    For the sets of blockers and waiters alone use ``contention``, which never forms pairs.
    """
    _check_by(by)
    rows = optional_filter(snapshot, db_name=db_name)
    touched_by = [*scope_of(snapshot), *RESOURCE]
    for name, value in (("session_id", spid), ("login_name", login)):
        if value is not None:
            touched = rows.where(F.col(name) == value).select(*touched_by).distinct()
            rows = rows.join(touched, touched_by, "left_semi")
    holders, waiters, on = _sides(rows, by)
    pairs = block_join(
        holders.select(*on, *[F.col(c).alias(n) for c, n in _HOLDER.items()]),
        waiters.select(*on, *[F.col(c).alias(n) for c, n in _WAITER.items()]),
        on,
    ).where(F.col("granted_SPID") != F.col("waiting_SPID"))
    if spid is not None:
        pairs = pairs.where((F.col("granted_SPID") == spid) | (F.col("waiting_SPID") == spid))
    if login is not None:
        pairs = pairs.where((F.col("login") == login) | (F.col("waiting_login") == login))
    renamed = pairs.withColumnsRenamed({"object_name": "locked_object_name", "resource_description": "resource"})
    return renamed.select(*scope_of(snapshot), *PAIR_COLUMNS)


def wait_classes(snapshot: DataFrame, by: str = "blocker", db_name: str | None = None, session: bool = False) -> DataFrame:
    """The wait pairs in factorised form: holder class, waiter class, and how many pairs the two make.

    A class is the lock rows of one resource that are alike in type, mode and status (holders) or in mode (waiters), so
    a resource has as many classes as modes are in use, however many rows it has.  ``holders`` and ``waiters`` count
    the rows of a class, ``pairs`` the pairs of rows of different sessions: the product of the two less the products
    of each session's own rows, which meet by resource and session.  Work and data are linear in the lock rows;
    ``wait_pairs`` expands the pairs.  By blocker a class belongs to one blocking session (``granted_SPID``);
    ``session=True`` keeps the waiting session apart too, which gives the pairs of every waiting session.
    """
    _check_by(by)
    held, awaited, on = _sides(optional_filter(snapshot, db_name=db_name), by)
    h_class, w_class = ["resource_type", "lock_mode", "lock_status"], ["waiting_lock_mode", *(["waiting_SPID"] if session else [])]

    def counted(side: DataFrame, names: dict[str, str], rows: str) -> DataFrame:
        """Rows by resource, class and session."""
        # one shuffle by the resource serves this grouping and those below
        known = reduce(lambda rows, c: rows.where(F.col(c).isNotNull()), [*on, "session_id"], side)
        return known.select(*dict.fromkeys([*on, *names])).repartition(*on).groupBy(*on, *[F.col(c).alias(n) for c, n in names.items()]).agg(F.count(F.lit(1)).alias(rows))

    h_rows = counted(held, {c: _HOLDER[c] for c in ("resource_type", "request_mode", "request_status", "session_id")}, "_h")
    w_rows = counted(awaited, {c: _WAITER[c] for c in ("request_mode", "session_id")}, "_w")
    pairs = h_rows.groupBy(*on, *h_class).agg(F.sum("_h").alias("holders")).join(
        # a hash table of a whole dealt part may outgrow a task; a merge spills
        w_rows.groupBy(*on, *w_class).agg(F.sum("_w").alias("waiters")).hint("merge"), on
    )
    own = F.lit(0)
    if by == "resource":
        # a session's own rows are no pairs; a blocker is never its own waiter
        mine = w_rows.withColumn("granted_SPID", F.col("waiting_SPID"))
        met = h_rows.join(mine.hint("merge"), [*on, "granted_SPID"]).groupBy(*on, *h_class, *w_class)
        less = met.agg(F.sum(F.col("_h") * F.col("_w")).alias("_own"))
        whole = [*on, *h_class, *w_class]
        alike = reduce(lambda a, c: a & (F.col(c) == F.col(f"_of_{c}")), on, _same([*h_class, *w_class]))
        pairs = pairs.join(less.select(*[F.col(c).alias(f"_of_{c}") for c in whole], "_own").hint("merge"), alike, "left")
        own = F.coalesce("_own", F.lit(0))
    counts = pairs.withColumn("pairs", F.col("holders") * F.col("waiters") - own).where("pairs > 0")
    shown = ["db_name", "hobt_id", F.col("object_name").alias("locked_object_name"), F.col("resource_description").alias("resource")]
    link = [F.col("_link").alias("granted_SPID")] if by == "blocker" else []
    return counts.select(*scope_of(snapshot), *shown, *h_class, *link, *w_class, "holders", "waiters", "pairs")


def waiting_sessions(snapshot: DataFrame, by: str = "blocker", db_name: str | None = None) -> DataFrame:
    """``waiting_SPID`` and its number of ``pairs``, from the classes."""
    classes = wait_classes(snapshot, by, db_name, session=True)
    return classes.groupBy(*scope_of(snapshot), "waiting_SPID").agg(F.sum("pairs").alias("pairs"))


def wait_pair_report(pairs: DataFrame, by: str = "blocker", counts: DataFrame | None = None) -> DataFrame:
    """Wait pairs by database, sessions with most pairs first; further columns decide between equals.

    ``counts`` are the pairs per waiting session, as ``waiting_sessions`` has them; without, the pairs are counted
    with partial aggregation and joined back, so a session with very many pairs is not gathered into one
    window group.
    """
    _check_by(by)
    if by == "blocker":
        pairs = pairs.where(F.col("waiter_blocking_session") == F.col("granted_SPID"))
    session = [*scope_of(pairs), "waiting_SPID"]
    counts = pairs.groupBy(*session).agg(F.count(F.lit(1)).alias("pairs")) if counts is None else counts
    order = [*scope_of(pairs), "db_name", F.desc("pairs"), "locked_object_name", _type_rank(), "granted_SPID", *PAIR_COLUMNS]
    return pairs.join(counts, session).orderBy(*order).select(*scope_of(pairs), *PAIR_COLUMNS)


# ------------------------------------------------------------------------------------------- contention


class Contention(NamedTuple):
    """Sessions and the resources they hold or wait for.

    Columns of both: fleet keys, ``session_id``, ``locked_object_name``, ``resource_type`` (of the holder),
    ``resource``; rows are distinct.
    """

    holders: DataFrame
    waiters: DataFrame


def contention(
    snapshot: DataFrame,
    by: str = "blocker",
    db_name: str | None = None,
    spid: int | None = None,
    login: str | None = None,
    stored: bool = False,
) -> Contention:
    """The distinct holders and waiters of ``wait_pairs`` with the same arguments, without forming pairs.

    ``stored=True`` stores the two sets, for use in several reports.

    A row is in a pair when the other side of its resource has a session other than its own.  The least
    and the greatest session id of that side decide this: at least one of them differs from the row's own
    exactly when some session does.  With a session or login filter, a row that does not meet the filter
    itself needs a partner that does, so the two ids are also kept for such partners alone.
    Work and data are linear in the number of lock rows, however many rows a resource has.
    """
    _check_by(by)
    scope = scope_of(snapshot)
    rows = optional_filter(snapshot, db_name=db_name)
    meets_spid = F.lit(True) if spid is None else F.col("session_id") == spid
    meets_login = F.lit(True) if login is None else F.coalesce(F.col("login_name") == login, F.lit(False))
    rows = rows.withColumn("_spid_ok", meets_spid).withColumn("_login_ok", meets_login)
    holders, waiters, on = _sides(rows, by)

    # which partners are acceptable, by what the row itself already meets
    classes = [(True, True)]
    if spid is not None:
        classes += [(False, login_ok) for _, login_ok in classes]
    if login is not None:
        classes += [(spid_ok, False) for spid_ok, _ in classes]

    def bounds(side: DataFrame, keys: Sequence[str]) -> DataFrame:
        aggregates = []
        for spid_ok, login_ok in classes:
            fits = F.lit(True)
            if not spid_ok:
                fits = fits & F.col("_spid_ok")
            if not login_ok:
                fits = fits & F.col("_login_ok")
            session = F.when(fits, F.col("session_id"))
            tag = f"{int(spid_ok)}{int(login_ok)}"
            aggregates += [F.min(session).alias(f"_low{tag}"), F.max(session).alias(f"_high{tag}")]
        return side.groupBy(*keys).agg(*aggregates)

    def partnered() -> Column:
        test = F.lit(False)
        for spid_ok, login_ok in classes:
            tag = f"{int(spid_ok)}{int(login_ok)}"
            applies = (F.col("_spid_ok") == spid_ok) & (F.col("_login_ok") == login_ok)
            if spid is None and login is None:
                applies = F.lit(True)
            other = (F.col(f"_low{tag}") != F.col("session_id")) | (F.col(f"_high{tag}") != F.col("session_id"))
            test = test | (applies & other)
        return test

    def distinct_parties(side: DataFrame, other: DataFrame, kind: str) -> DataFrame:
        own = dict.fromkeys([*on, "session_id", "_spid_ok", "_login_ok"])
        if kind in side.columns:
            own[kind] = None
        met = side.select(*own).join(other.hint("merge"), on).where(partnered())
        return met.select(
            *scope,
            "session_id",
            F.col("object_name").alias("locked_object_name"),
            F.col(kind).alias("resource_type"),
            F.col("resource_description").alias("resource"),
        ).distinct()

    # one shuffle a side by the resource serves the bounds and the join with them
    shared = [*on, "session_id", "_spid_ok", "_login_ok"]
    held_as = holders.withColumnRenamed("resource_type", "_held_type").select(*dict.fromkeys([*shared, "_held_type"])).repartition(*on)
    waiters = waiters.select(*dict.fromkeys(shared)).repartition(*on)
    found = Contention(
        holders=distinct_parties(held_as, bounds(waiters, on), "_held_type"),
        waiters=distinct_parties(waiters, bounds(held_as, [*on, "_held_type"]), "_held_type"),
    )
    return Contention(*map(stored_rows, found)) if stored else found


# --------------------------------------------------------------------------------------------- overviews


def session_overview(
    snapshot: DataFrame,
    holders: DataFrame,
    active_snapshot_tx: DataFrame,
    db_name: str | None = None,
    spid: int | None = None,
    login: str | None = None,
    strict_reference: bool = False,
) -> DataFrame:
    """One row per session: lock counts, objects touched, isolation level, blocker mark.

    ``holders`` are the blocking sessions (``contention(...).holders``, or any frame with ``session_id``).
    Each lock row is counted once under its object and once under its database.  The first grouping makes
    these distinct per session, the second counts them, so a hot session is counted by many tasks.  Both group by
    numbers: session id and 64-bit codes of names and of the session's other columns, which are joined last,
    from one row per session and task.
    ``strict_reference=True`` names isolation level 2 the same with and without a row version
    transaction.
    """
    scope = scope_of(snapshot)
    attributes = [
        "login_name",
        "host_name",
        "status",
        "blocking_session_id",
        "transaction_il",
        "text",
        "open_transaction_count",
    ]
    # lock rows are grouped by numbers alone; names and texts follow with one row per session
    rows = optional_filter(snapshot, db_name=db_name, session_id=spid, login_name=login).withColumn("_who", _code(*attributes))
    who = [*scope, "session_id", "_who"]
    nonintent = _is_granted() & ~F.col("request_mode").startswith("I") & (F.col("resource_type") == "OBJECT")
    none = F.lit(False)

    def item(is_db: bool, name: str, granted: Column, waiting: Column, plain: Column) -> Column:
        return F.struct(
            F.lit(is_db).alias("is_db"),
            F.when(F.col(name).isNotNull(), _code(name)).alias("name"),
            granted.alias("granted"),
            waiting.alias("waiting"),
            plain.alias("nonintent"),
        )

    items = F.array(
        item(False, "object_name", _is_granted(), _is_waiting(), nonintent), item(True, "db_name", none, none, none)
    )
    touched = (
        rows.select(*who, F.explode(items).alias("_item"))
        .groupBy(*who, F.col("_item.is_db").alias("_is_db"), F.col("_item.name").alias("_name"))
        .agg(*[F.count_if(F.col(f"_item.{c}")).alias(f"_{c}") for c in ("granted", "waiting", "nonintent")])
    )
    named = F.col("_name").isNotNull()

    def objects_with(counter: str) -> Column:
        return F.count_if(~F.col("_is_db") & named & (F.col(counter) > 0))

    tallied = touched.groupBy(*who).agg(
        F.count_if(F.col("_is_db") & named).alias("locks_in_dbs"),
        F.sum("_granted").alias("granted_locks"),
        F.sum("_waiting").alias("waiting_locks"),
        objects_with("_granted").alias("objects_with_granted_locks"),
        objects_with("_waiting").alias("objects_with_waiting_locks"),
        objects_with("_nonintent").alias("nonintent_objects_granted_locks"),
    )
    profiles = rows.select(*who, *attributes).distinct()
    per_session = tallied.join(profiles.select(*[F.col(c).alias(f"_of_{c}") for c in who], *attributes), _same(who)).drop(*[f"_of_{c}" for c in who])

    def flagged(df: DataFrame, marks: DataFrame, flag: str) -> DataFrame:
        on = [*scope_of(df, marks), "session_id"]
        return df.join(marks.select(*on).distinct().withColumn(flag, F.lit(True)), on, "left")

    marked = flagged(flagged(per_session, holders, "_blocks"), active_snapshot_tx, "_versioned")
    blocks = F.col("_blocks").isNotNull()
    level = F.col("transaction_il")
    isolation = F.lit("UNKNOWN")
    for code, name in ISOLATION_LEVELS.items():
        isolation = F.when(level == code, F.lit(name)).otherwise(isolation)
    versioned = level == 2 if strict_reference else (level == 2) & F.col("_versioned").isNotNull()
    isolation = F.when(versioned, F.lit(SNAPSHOT_READS)).otherwise(isolation)
    sleeping = (F.col("granted_locks") > 0) & (F.upper("status") == "SLEEPING")
    order = [
        F.when(blocks, 0).otherwise(1),
        F.when(blocks, F.lit(9999).cast("bigint")).otherwise(F.col("waiting_locks")).desc(),
        F.desc("granted_locks"),
        *scope,
        "session_id",
        *attributes,
    ]
    return marked.orderBy(*order).select(
        *scope,
        "session_id",
        "login_name",
        "host_name",
        F.when(sleeping, F.upper("status")).otherwise(F.col("status")).alias("status"),
        "open_transaction_count",
        isolation.alias("isolation_level"),
        "text",
        "locks_in_dbs",
        "granted_locks",
        "waiting_locks",
        "objects_with_granted_locks",
        "objects_with_waiting_locks",
        "nonintent_objects_granted_locks",
        F.when(blocks, F.lit("V")).otherwise(F.lit("")).alias("blocker_mark"),
    )


def object_overview(
    snapshot: DataFrame, db_name: str | None = None, spid: int | None = None, login: str | None = None
) -> DataFrame:
    """Lock counts per (database, object) and the object's share of its database.

    Lock rows are first reduced to one row per (database, object, session), which makes the session counts
    plain sums; a hot object is thereby counted by many tasks.
    """
    scope = scope_of(snapshot)
    rows = optional_filter(snapshot, db_name=db_name, session_id=spid, login_name=login)
    kind = F.col("resource_type")
    counters = {
        "overall_locks": F.lit(True),
        "granted_locks": _is_granted(),
        "waiting_locks": _is_waiting(),
        "object_nonintent_locks_granted": (kind == "OBJECT")
        & ~F.col("request_mode").startswith("I")
        & _is_granted(),
        "object_locks_waiting": (kind == "OBJECT") & _is_waiting(),
        "key_locks_granted": kind.isin(*ROW_LOCKS) & _is_granted(),
        "key_locks_waiting": kind.isin(*ROW_LOCKS) & _is_waiting(),
        "page_locks_granted": (kind == "PAGE") & _is_granted(),
        "page_locks_waiting": (kind == "PAGE") & _is_waiting(),
        "_key_locks": kind.isin(*ROW_LOCKS),
    }
    per_session = rows.groupBy(*scope, "db_name", "object_name", "session_id").agg(
        *[F.count_if(test).alias(name) for name, test in counters.items()]
    )
    known = F.col("session_id").isNotNull()
    per_object = per_session.groupBy(*scope, "db_name", "object_name").agg(
        *[F.sum(name).alias(name) for name in counters],
        F.count_if(known & (F.col("granted_locks") > 0)).alias("sessions_with_granted_locks"),
        F.count_if(known & (F.col("waiting_locks") > 0)).alias("waiting_sessions"),
    )
    per_db = rows.groupBy(*scope, "db_name").agg(F.count(F.lit(1)).alias("locks_in_db_overall"))
    joined = per_object.join(per_db, [*scope, "db_name"])
    return joined.orderBy(F.desc("waiting_locks"), *scope, "db_name", "object_name").select(
        *scope,
        "db_name",
        "object_name",
        "overall_locks",
        "granted_locks",
        "sessions_with_granted_locks",
        "waiting_sessions",
        "waiting_locks",
        "object_nonintent_locks_granted",
        "object_locks_waiting",
        "key_locks_granted",
        "key_locks_waiting",
        "page_locks_granted",
        "page_locks_waiting",
        half_up(F.col("_key_locks") * 100, F.col("overall_locks"), 2).alias("key_locks_pctg"),
        "locks_in_db_overall",
        half_up(F.col("overall_locks") * 100, F.col("locks_in_db_overall"), 2).alias("tbl_locks_in_db_pctg"),
    )


# ---------------------------------------------------------------------------------------- lock details
#
# The three details share their arguments: ``once=False`` shows a lock row once per contended resource of its
# session instead of once; ``ordered=False`` leaves out the report order, which sorts all rows.

# What a session in contention does.
ROLES = ("head", "mid", "leaf")

_DETAIL = (
    "session_id",
    "login_name",
    "host_name",
    "status",
    "db_name",
    "object_name",
    "resource_type",
    "resource_description",
    "hobt_id",
    "request_type",
    "request_status",
    "request_mode",
    "open_transaction_count",
    "text",
)


def _marked(text: Column) -> Column:
    return F.concat(F.lit("___"), text, F.lit("___"))


def _shown(snapshot: DataFrame, rows: DataFrame, hit: Column, waits: Column | bool, ordered: bool, extra: Sequence[str]) -> DataFrame:
    """Detail rows with the contended resource and, of sessions that wait, the status of waits marked."""
    status = F.col("request_status")
    changed = {
        "object_name": F.when(hit, _marked(F.col("object_name"))).otherwise(F.col("object_name")),
        "request_status": F.when(F.lit(waits) & (status != GRANTED), _marked(status)).otherwise(status),
    }
    columns = [*scope_of(snapshot), *_DETAIL, *extra]
    if ordered:
        rows = rows.orderBy(*scope_of(snapshot), "session_id", "db_name", "object_name", _type_rank(), *_DETAIL, *extra)
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in columns])


def lock_details(snapshot: DataFrame, parties: Contention, roles: Sequence[str] = ROLES, ordered: bool = False) -> DataFrame:
    """Every lock row of the sessions in contention once, with the session's ``role`` and its contended resources marked.

    ``head`` sessions block others and wait for nobody, ``mid`` sessions do both, ``leaf`` sessions only wait.  The
    parties are reduced in one pass to a row per session (its role) and a row per session and resource (what to
    mark); the lock rows are joined with the one, then with the other.  Neither holds more than the parties do,
    and a hot session is a key-unique join that adaptive execution may split.
    """
    scope = scope_of(snapshot, parties.holders)
    session = [*scope, "session_id"]
    ends = parties.holders.withColumn("_holds", F.lit(True)).unionByName(parties.waiters.withColumn("_holds", F.lit(False)))
    holds, waits = F.bool_or("_holds").alias("_held"), F.bool_or(~F.col("_holds")).alias("_awaited")
    role = F.when(~F.col("_awaited"), "head").when(F.col("_held"), "mid").otherwise("leaf")
    by_session = ends.groupBy(*session).agg(holds, waits).select(*session, role.alias("role"))
    resource = [F.col("locked_object_name").alias("object_name"), "resource_type", F.col("resource").alias("resource_description")]
    marks = ends.groupBy(*session, *resource).agg(holds, waits)
    wanted = by_session.where(F.col("role").isin(*roles))
    rows = snapshot.join(wanted, session).join(marks, [*session, "object_name", "resource_type", "resource_description"], "left")
    hit = F.coalesce(F.when(F.col("role") == "leaf", F.col("_awaited")).otherwise(F.col("_held")), F.lit(False))
    return _shown(snapshot, rows, hit, F.col("role") != "head", ordered, ["blocking_session_id", "role"])


def _repeated(snapshot: DataFrame, contended: DataFrame, waits: bool, ordered: bool) -> DataFrame:
    """All lock rows of the sessions of ``contended``, once per contended resource of their session."""
    scope = scope_of(snapshot, contended)
    wanted = contended.select(
        *scope,
        "session_id",
        F.col("locked_object_name").alias("_name"),
        F.col("resource_type").alias("_type"),
        F.col("resource").alias("_resource"),
    )
    rows = block_join(snapshot, wanted, [*scope, "session_id"])
    hit = (
        (F.col("_name") == F.col("object_name"))
        & (F.col("_type") == F.col("resource_type"))
        & (F.col("_resource") == F.col("resource_description"))
    )
    return _shown(snapshot, rows, hit, waits, ordered, ["blocking_session_id"] if waits else [])


def _sessions(df: DataFrame, other: DataFrame, how: str) -> DataFrame:
    on = [*scope_of(df, other), "session_id"]
    return df.join(other.select(*on).distinct(), on, how)


def head_blockers(snapshot: DataFrame, parties: Contention, once: bool = True, ordered: bool = True) -> DataFrame:
    """Locks of the sessions that block others and wait for nobody."""
    if once:
        return lock_details(snapshot, parties, ["head"], ordered).drop("role", "blocking_session_id")
    return _repeated(snapshot, _sessions(parties.holders, parties.waiters, "left_anti"), False, ordered)


def mid_blockers(snapshot: DataFrame, parties: Contention, once: bool = True, ordered: bool = True) -> DataFrame:
    """Locks of the sessions that block others and wait themselves."""
    if once:
        return lock_details(snapshot, parties, ["mid"], ordered).drop("role")
    return _repeated(snapshot, _sessions(parties.holders, parties.waiters, "left_semi"), True, ordered)


def leaf_waiters(snapshot: DataFrame, parties: Contention, once: bool = True, ordered: bool = True) -> DataFrame:
    """Locks of the sessions that only wait."""
    if once:
        return lock_details(snapshot, parties, ["leaf"], ordered).drop("role")
    return _repeated(snapshot, _sessions(parties.waiters, parties.holders, "left_anti"), True, ordered)


# ------------------------------------------------------------------------------------- single sessions


def session_locks(
    locks: DataFrame, partitions: DataFrame, objects: DataFrame, session_id: int | None = None
) -> DataFrame:
    """Locks of one session (or of every session) counted by mode, status, object and type; waits first.

    Lock rows are counted per resource id before the names are joined.
    """
    picked = optional_filter(locks, request_session_id=session_id).where(F.col("resource_type") != "DATABASE")
    scope = scope_of(locks)
    who = [*scope, "request_session_id"]
    entity = ["resource_database_id", "resource_associated_entity_id"]
    what = ["request_mode", "request_status", "resource_type"]
    counted = picked.groupBy(*who, *entity, *what).agg(F.count(F.lit(1)).alias("_locks"))
    # every type but OBJECT is looked up as a partition here
    kind = F.col("resource_type")
    as_lookup = counted.withColumn("_type", kind).withColumn(
        "resource_type", F.when(kind == "OBJECT", kind).otherwise(F.lit("HOBT"))
    )
    named = resolve_names(as_lookup, partitions, objects, fallback=False).withColumn("resource_type", F.col("_type"))
    groups = [*who, "request_mode", "request_status", "object_name", "resource_type"]
    summed = named.groupBy(*groups).agg(F.sum("_locks").alias("total_locks"))
    waits_first = F.when(F.col("request_status").isin("WAIT", "CONVERT"), 1).otherwise(2)
    return summed.orderBy(*who, waits_first, "object_name", "resource_type", "request_mode").select(
        *scope,
        F.col("request_session_id").alias("session_id"),
        "request_mode",
        "request_status",
        F.col("object_name").alias("locked_object"),
        "resource_type",
        "total_locks",
    )


def blocked_by(requests: DataFrame, session_id: int | None = None) -> DataFrame:
    """How many requests a session (or each session) blocks, and the lowest blocked session id."""
    blocking = optional_filter(requests, blocking_session_id=session_id).where(
        F.col("blocking_session_id").isNotNull() & (F.col("blocking_session_id") != 0)
    )
    return (
        blocking.groupBy(*scope_of(requests), F.col("blocking_session_id").alias("_blocker"))
        .agg(
            F.count(F.lit(1)).alias("blocked_sessions_count"),
            F.min("session_id").alias("min_blocked_session_id"),
        )
        .withColumnRenamed("_blocker", "session_id")
    )


def lock_report(
    locks: DataFrame, requests: DataFrame, partitions: DataFrame, objects: DataFrame, session_id: int
) -> dict[str, DataFrame]:
    """A session's locks and, when it blocks others, the locks of the lowest session it blocks."""
    blocked = blocked_by(requests, session_id)
    scope = scope_of(locks, blocked)
    # one row at most per server and capture
    lowest = blocked.select(*scope, F.col("min_blocked_session_id").alias("request_session_id"))
    of_blocked = locks.join(lowest, [*scope, "request_session_id"], "left_semi")
    return {
        "blocked": blocked,
        "locks": session_locks(locks, partitions, objects, session_id),
        "blocked_locks": session_locks(of_blocked, partitions, objects),
    }


def lock_reports(
    locks: DataFrame, requests: DataFrame, partitions: DataFrame, objects: DataFrame, sessions: DataFrame | None = None
) -> DataFrame:
    """The lock reports of all sessions of ``sessions`` (column ``session_id``), or of all that block others, in one table.

    ``report_of`` names the session a report is about, ``section`` is ``locks`` or ``blocked_locks`` (of the lowest
    session it blocks).  The locks are counted once, by session, and joined with the reports that show them, so the
    number of reports doesn't matter.
    """
    blocked = blocked_by(requests)
    scope = scope_of(locks, blocked)
    wanted = blocked if sessions is None else sessions
    about = wanted.select(*scope_of(wanted, blocked), "session_id").distinct()
    own = about.select(*scope, F.col("session_id").alias("report_of"), F.lit("locks").alias("section"), "session_id")
    lowest = blocked.join(about, [*scope_of(blocked, about), "session_id"], "left_semi").select(
        *scope, F.col("session_id").alias("report_of"), F.lit("blocked_locks").alias("section"), F.col("min_blocked_session_id").alias("session_id")
    )
    counted = session_locks(locks, partitions, objects)
    columns = [c for c in counted.columns if c not in scope]
    return own.unionByName(lowest).join(counted, [*scope, "session_id"]).select(*scope, "report_of", "section", *columns)


def locking_report(
    inputs: LockInputs,
    active_snapshot_tx: DataFrame,
    mode: str = "OVERVIEW",
    db_name: str | None = None,
    db_id: int | None = None,
    spid: int | None = None,
    login: str | None = None,
    by: str = "blocker",
    chains: bool = False,
    snapshot_path: str | None = None,
    refresh: bool = True,
    system_databases: bool = False,
    system_sessions: bool = False,
    own_session_id: int | None = None,
    strict_reference: bool = False,
    once: bool = True,
    ordered: bool = True,
    depth: str = "reference",
) -> dict[str, DataFrame]:
    """The whole locking report as named frames, all over one snapshot.

    OVERVIEW gives ``wait_pairs``, ``sessions`` and ``objects``; DETAILED adds ``head_blockers``,
    ``mid_blockers`` and ``leaf_waiters`` (``once`` and ``ordered`` as there); ``chains`` adds ``blocking_chains`` of
    the given ``depth``.  With ``snapshot_path`` the snapshot is stored there, and reused unless ``refresh`` is
    set; without, it is stored in the work folder.  Holders and waiters are stored once for all sections.
    """
    if mode not in MODES:
        warnings.warn(f"unknown mode {mode!r}, using OVERVIEW", stacklevel=2)
        mode = "OVERVIEW"
    if db_name is not None or db_id is not None:
        named = optional_filter(inputs.databases, name=db_name, database_id=db_id)
        require_exists(named, F.lit(True), "no database has the given name and id")
        if db_id is not None:
            db_name = named.select("name").first()["name"]

    def build() -> DataFrame:
        return lock_snapshot(inputs, system_databases, system_sessions, own_session_id, strict_reference)

    if snapshot_path is not None:
        snapshot = load_or_build(inputs.locks.sparkSession, snapshot_path, build, refresh)
    else:
        snapshot = stored_rows(build(), "locks")
    wanted = {"db_name": db_name, "spid": spid, "login": login}
    pairing = stored_rows(_in_pairs(snapshot), "pairing") if by == "blocker" else snapshot
    parties = contention(pairing, by, **wanted, stored=True)
    # with a session or login the pairs are few and counted themselves
    counts = waiting_sessions(pairing, by, db_name) if spid is None and login is None else None
    report = {
        "snapshot": snapshot,
        "wait_pairs": wait_pair_report(wait_pairs(pairing, by, **wanted), by, counts),
        "sessions": session_overview(
            snapshot, parties.holders, active_snapshot_tx, **wanted, strict_reference=strict_reference
        ),
        "objects": object_overview(snapshot, **wanted),
    }
    if mode == "DETAILED":
        report["head_blockers"] = head_blockers(snapshot, parties, once, ordered)
        report["mid_blockers"] = mid_blockers(snapshot, parties, once, ordered)
        report["leaf_waiters"] = leaf_waiters(snapshot, parties, once, ordered)
    if chains:
        report["blocking_chains"] = blocking_chains(snapshot, depth)
    return report


def report_table(report: Mapping[str, DataFrame], sections: Sequence[str] | None = None) -> DataFrame:
    """The sections of a report as one long table: ``section``, ``row_number`` (from 1) and ``columns``, a map of texts.

    Every section but the snapshot, or those named.  A row's number is its place in the section's order: a
    sorted section is numbered where it lies, from its rows per task, without another sort.  The numbered
    sections are stored, so the table can be stored, filtered and compared as a whole.
    """
    parts = []
    for section, rows in report.items():
        if section in (sections if sections is not None else report.keys() - {"snapshot"}):
            cells = [cell for name in rows.columns for cell in (F.lit(name), F.col(f"`{name}`").cast("string"))]
            numbered = number_any(rows, "_place")
            parts.append(numbered.select(F.lit(section).alias("section"), (F.col("_place") + 1).alias("row_number"), F.create_map(*cells).alias("columns")))
    return reduce(DataFrame.unionByName, parts)
