"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docreg.common import reliable


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable from each id of an edge. In each
    round an id takes the least label among its own and its neighbours', then the
    label of that label; labels are written after every round and the rounds end
    when none has changed. Minima are combined before they are shuffled, so an id
    with very many neighbours is no hot group.

    Defined results: loops and repeated edges change nothing; edges with a null
    end are left out; without edges there are no rows."""
    ends = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    both = reliable(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = reliable(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        least = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("new"))
        jump = labels.select(F.col("id").alias("new"), F.col("component").alias("far"))
        moved = reliable(least.join(jump, "new").select("id", "old", F.least("new", "far").alias("component")))
        labels = moved.select("id", "component")
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            return labels
