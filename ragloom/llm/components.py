"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ragloom.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of the nodes of edges; root is the smallest node of the component.

    Labels only move to smaller nodes: each round a node takes the smallest label among its
    neighbours and then its label's label, so that rounds grow with the logarithm of a chain's
    length. Lineage is cut each round. Null ends are dropped, repeated edges and loops do no harm;
    no edges give no rows.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    both = cut(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("l"))
    while True:
        near = both.join(labels.select(F.col("x").alias("y"), F.col("l").alias("yl")), "y").groupBy("x").agg(F.min("yl").alias("m"))
        moved = labels.join(near, "x").select("x", "l", F.least("l", "m").alias("n"))
        jumped = moved.join(moved.select(F.col("x").alias("n"), F.col("n").alias("nn")), "n", "left")
        done = jumped.select("x", "l", F.least("n", F.coalesce("nn", "n")).alias("n"))
        seen = Observation()
        labels = cut(done.observe(seen, F.count_if(F.col("n") < F.col("l")).alias("changed"))).select("x", F.col("n").alias("l"))
        if not seen.get["changed"]:
            return labels.select(F.col("x").alias("node"), F.col("l").alias("root"))
