"""The operators, by subject."""

from fleetvitals.operators.catalog import (
    Catalog,
    child_pieces,
    collation_scripts,
    join_children,
    move_commands,
    object_sizes,
    object_sizes_all,
    render,
)
from fleetvitals.operators.chains import blocking_chains, blocking_edges, chain_roots, expand_chains, full_chains
from fleetvitals.operators.counters import (
    counter_deltas,
    health_report,
    io_delta,
    io_snapshot,
    wait_delta,
    wait_report,
)
from fleetvitals.operators.filters import (
    IGNORED_WAITS,
    active_waits,
    optional_filter,
    pending_work,
    placement_drift,
    require_exists,
    secondary_indexes,
    select_names,
)
from fleetvitals.operators.ledger import apply_events, extend_ledger, ledger_report, next_pending
from fleetvitals.operators.locks import (
    Contention,
    LockInputs,
    blocked_by,
    contention,
    head_blockers,
    leaf_waiters,
    lock_details,
    lock_report,
    lock_reports,
    lock_snapshot,
    locking_report,
    mid_blockers,
    object_overview,
    report_table,
    resolve_names,
    session_locks,
    session_overview,
    wait_classes,
    wait_pair_report,
    wait_pairs,
    waiting_sessions,
)
from fleetvitals.operators.tables import (
    add_seconds,
    delete_expired,
    delete_where,
    generate_sequence,
    generate_tasks,
    repeat_update,
    sample_exact,
    to_fixed_width,
    top_k,
    update_all,
    update_where_in,
    with_defaults,
)
from fleetvitals.operators.workload import (
    index_usage,
    plan_divergence,
    plans_for_query,
    rollup_query_stats,
    top_queries,
)

__all__ = [
    "Catalog",
    "Contention",
    "IGNORED_WAITS",
    "LockInputs",
    "active_waits",
    "add_seconds",
    "apply_events",
    "blocked_by",
    "blocking_chains",
    "blocking_edges",
    "chain_roots",
    "child_pieces",
    "collation_scripts",
    "contention",
    "counter_deltas",
    "delete_expired",
    "delete_where",
    "expand_chains",
    "extend_ledger",
    "full_chains",
    "generate_sequence",
    "generate_tasks",
    "head_blockers",
    "health_report",
    "index_usage",
    "io_delta",
    "io_snapshot",
    "join_children",
    "leaf_waiters",
    "ledger_report",
    "lock_details",
    "lock_report",
    "lock_reports",
    "lock_snapshot",
    "locking_report",
    "mid_blockers",
    "move_commands",
    "next_pending",
    "object_overview",
    "object_sizes",
    "object_sizes_all",
    "optional_filter",
    "pending_work",
    "placement_drift",
    "plan_divergence",
    "plans_for_query",
    "render",
    "report_table",
    "repeat_update",
    "require_exists",
    "resolve_names",
    "rollup_query_stats",
    "sample_exact",
    "secondary_indexes",
    "select_names",
    "session_locks",
    "session_overview",
    "to_fixed_width",
    "top_k",
    "top_queries",
    "update_all",
    "update_where_in",
    "wait_classes",
    "wait_delta",
    "wait_pair_report",
    "wait_pairs",
    "wait_report",
    "waiting_sessions",
    "with_defaults",
]
