"""Telemetry derived from the given tables, the registered queries over it, and their SQL counterparts."""
