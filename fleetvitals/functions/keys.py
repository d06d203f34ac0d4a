"""Fleet keys.

One server at one instant needs no extra keys.  When the landed telemetry holds many servers or many
captures, the columns below identify them, and every operator adds those that its inputs share to its own
join and grouping keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

SERVER_SCOPE = ("server_id",)
SCOPE = ("server_id", "captured_at")
CATALOG_SCOPE = ("server_id", "captured_at", "database_id")


def scope_of(*frames: DataFrame, names: Sequence[str] = SCOPE) -> list[str]:
    """The fleet columns that all of the given frames carry."""
    return [n for n in names if all(n in f.columns for f in frames)]
