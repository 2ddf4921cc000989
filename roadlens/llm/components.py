"""Connected components by hooking and contraction, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """node and component (its smallest member) of every node that an edge touches.

    Each round every node hooks to its smallest neighbour, hooks are followed twice, and the graph
    is contracted; a component of n nodes takes at most about log2(n) rounds, a star takes one.
    Loops, repeated edges and edges with a null end add nothing. Only counts reach the driver.
    """
    with scratch() as keep:
        left = durable(
            edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
        )
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        found = durable(nodes.select("node", F.col("node").alias("component")), "labels")
        left = left.where("a <> b")
        for _ in range(rounds):
            if left.isEmpty():
                break
            both = left.union(left.select(F.col("b"), F.col("a")))
            hooked = both.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("node"), F.least("a", "_m").alias("parent"))
            hooks = durable(hooked.where("parent <> node"), "hooks")
            for _ in range(2):
                above = hooks.select(F.col("node").alias("_node"), F.col("parent").alias("_up"))
                hooks = hooks.join(above, hooks["parent"] == above["_node"], "left").select("node", F.coalesce("_up", "parent").alias("parent"))
            hooks = durable(hooks, "hooks")
            of_a = hooks.select(F.col("node").alias("a"), F.col("parent").alias("_pa"))
            of_b = hooks.select(F.col("node").alias("b"), F.col("parent").alias("_pb"))
            moved = left.join(of_a, "a", "left").join(of_b, "b", "left").select(F.coalesce("_pa", "a").alias("a"), F.coalesce("_pb", "b").alias("b"))
            left = durable(moved.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
            of = hooks.select(F.col("node").alias("component"), F.col("parent").alias("_p"))
            found = durable(found.join(of, "component", "left").select("node", F.coalesce("_p", "component").alias("component")), "labels")
        else:
            raise RuntimeError("components did not settle")
        return keep(found)
