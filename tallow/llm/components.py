"""Connected components of a graph in tables: smallest label of the neighbours, then label of the label, until nothing changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, holding, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component: the smallest node reachable) of every node of an edge. Edges may repeat; order does not count.

    Every round is written to the shared folder. Labels halve their distance to the smallest node at
    least about every round, so that the rounds grow with the logarithm of a component's diameter.
    """
    one_way = edges.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    both = stored(one_way.unionByName(one_way.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        hooked = labels.select("node", "component").join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        of = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = hooked.join(of, "component").select("node", F.least("component", "next").alias("component"), (F.least("component", "next") < F.col("was")).alias("changed"))
        step = stored(jumped, "labels")
        discard(labels)
        labels = step
        if step.filter("changed").isEmpty():
            discard(both)
            return holding(step.drop("changed"), step)
