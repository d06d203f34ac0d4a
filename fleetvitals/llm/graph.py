"""Connected components of a graph of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetvitals.plans import durable


def components(links: DataFrame, low: str = "a", high: str = "b") -> DataFrame:
    """``id`` and ``component`` (the least id it reaches) of every id that has a link.

    Every round an id takes the least label among its neighbours, and then the label of that label, so labels
    travel twice as far each time and long chains take few rounds.  Minima are combined before they are
    shuffled, so a hub with very many links is no hot key.  Each round is checkpointed.
    """
    both = durable(
        links.select(F.col(low).alias("x"), F.col(high).alias("y"))
        .union(links.select(F.col(high), F.col(low)))
        .where("x <> y")
        .distinct()
    )
    labels = durable(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("_m")).select("id", F.least("id", "_m").alias("component")))
    while True:
        near = (
            both.join(labels.select(F.col("id").alias("y"), F.col("component").alias("_c")), "y")
            .groupBy(F.col("x").alias("id"))
            .agg(F.min("_c").alias("_near"))
        )
        stepped = labels.join(near, "id").select("id", "component", F.least("component", "_near").alias("_new"))
        jump = labels.select(F.col("id").alias("_new"), F.col("component").alias("_far"))
        stepped = durable(
            stepped.join(jump, "_new").select("id", F.least("_new", "_far").alias("component"), (F.least("_new", "_far") < F.col("component")).alias("_moved"))
        )
        labels = stepped.select("id", "component")
        if stepped.where("_moved").isEmpty():
            return labels
