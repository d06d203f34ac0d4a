"""Landed telemetry relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from fleetvitals.schemas import RELATIONS, conform


def read_relation(
    spark: SparkSession,
    path: str,
    relation: str | T.StructType,
    format: str = "parquet",
    **options: str,
) -> DataFrame:
    """Read one relation.

    With a relation name, self-describing files keep the types they were landed with and are checked
    against the relation; text formats are read with its schema.  With a schema of one's own, that schema
    is used as it is.
    """
    reader = spark.read.format(format).options(**options)
    if not isinstance(relation, str):
        return reader.schema(relation).load(path)
    if format in ("parquet", "orc"):
        return conform(reader.load(path), relation)
    return conform(reader.schema(RELATIONS[relation]).load(path), relation)
