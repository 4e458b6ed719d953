"""Connected components of a distributed edge list: smallest label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(v, label) for every vertex of ``edges`` (a, b): label is the smallest vertex it reaches.

    Each round takes the smallest label among neighbours (aggregated on the map
    side, so a hub costs one row a task) and jumps to the label's own label; rounds
    grow with the logarithm of a component's width.  Each round is a written table.
    """
    both = scratch.put(f"{name}-edges", edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = scratch.put(f"{name}-0", both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    k = 0
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near, labels.v == near.a).select("v", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("v").alias("u"), F.col("label").alias("jump"))
        new = low.join(up, low.low == up.u, "left").select("v", F.least("low", F.coalesce("jump", "low")).alias("label"), (F.least("low", F.coalesce("jump", "low")) != F.col("label")).alias("moved"))
        k += 1
        step = scratch.put(f"{name}-{k}", new)
        if k > 1:
            scratch.drop(f"{name}-{k - 1}")
        if step.filter("moved").limit(1).count() == 0:
            return step.select("v", "label")
        labels = step.select("v", "label")
