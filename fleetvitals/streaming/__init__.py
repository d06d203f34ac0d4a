"""Continuous counter deltas over a stream of captures."""

from fleetvitals.streaming.deltas import delta_stream
from fleetvitals.streaming.sink import delta_sink

__all__ = ["delta_sink", "delta_stream"]
