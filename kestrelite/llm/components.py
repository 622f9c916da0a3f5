"""Connected components of an edge table, by minimum labels with pointer jumping; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every vertex of ``edges`` (a, b) with the smallest vertex that it reaches.

    Each round a vertex takes the least label among its neighbours' and then its label's label, so the rounds grow with
    the logarithm of the longest chain. Labels only fall and are compared by a count, so the loop ends at the fixed point.
    A vertex with very many edges is met by partial aggregation on its own side and by adaptive skew splits on the other.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("now"))
        own = labels.select(F.col("id").alias("now"), F.col("component").alias("jump"))
        stepped = written(lower.join(own, "now").select("id", "old", F.least("now", "jump").alias("component")), "labels")
        changed = stepped.where("old <> component").limit(1).count()
        labels = stepped.select("id", "component")
        if not changed:
            return labels
