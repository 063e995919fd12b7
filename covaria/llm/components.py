"""Connected components by rounds of hooking and contraction, all in joins and grouped minima."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Edges of two longs to (node, component): each node that has an edge, and the smallest it can reach.

    Each round hooks every node to its smallest smaller neighbour, jumps once along the hooks, and
    replaces the ends of all edges by what they hang on. Edges inside one node vanish and no two
    neighbours can both stay, so few rounds suffice; each is written to the shared folder. A node
    with very many neighbours costs a partial minimum per task and joins that Spark can split.

    Null ends and loops are ignored; repeated edges count once; no edges give no rows.
    """
    a_, b_ = F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    live = cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a_, b_).where("a < b").distinct())
    first, hooks = live, []
    while not live.isEmpty():
        hook = live.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("to"))
        jump = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
        hook = cut(hook.join(jump, "to", "left").select("node", F.coalesce("next", "to").alias("to")))
        hooks.append(hook)
        for end in ("a", "b"):
            step = hook.select(F.col("node").alias(end), "to")
            other = "b" if end == "a" else "a"
            live = live.join(step, end, "left").select(F.coalesce("to", end).alias(end), other)
        live = cut(live.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())

    def follow(found: DataFrame, hook: DataFrame) -> DataFrame:
        return found.join(hook.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))

    nodes = first.select(F.col("a").alias("node")).union(first.select("b")).distinct()
    return reduce(follow, hooks, nodes.withColumn("component", F.col("node")))
