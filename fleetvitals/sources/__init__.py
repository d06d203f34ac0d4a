"""Reading, capturing and storing telemetry."""

from fleetvitals.sources.relations import read_relation
from fleetvitals.sources.snapshots import (
    AFTER,
    BEFORE,
    append_snapshot,
    capture,
    fan_out,
    load_or_build,
    release,
    write_snapshot,
)

__all__ = [
    "AFTER",
    "BEFORE",
    "append_snapshot",
    "capture",
    "fan_out",
    "load_or_build",
    "read_relation",
    "release",
    "write_snapshot",
]
