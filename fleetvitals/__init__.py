"""Analytics over landed database-server telemetry, on Spark DataFrames."""

from fleetvitals.operators import *  # noqa: F403
from fleetvitals.operators import __all__ as _operators
from fleetvitals.plans import block_join, durable, number_any, number_rows, repeat_rows, tune
from fleetvitals.schemas import RELATIONS, conform
from fleetvitals.sources import *  # noqa: F403
from fleetvitals.sources import __all__ as _sources
from fleetvitals.streaming import delta_sink, delta_stream

__all__ = [*_operators, *_sources, "RELATIONS", "block_join", "conform", "delta_sink", "delta_stream", "durable", "number_any", "number_rows", "repeat_rows", "tune"]
