"""Transitive closure of a pair predicate within groups (equivalence classes of boxes)."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the shared folder of the cluster, which spark.checkpoint.dir names."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return df.checkpoint()


def cluster(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """node and cluster (the smallest member) of every node; edges are pairs (a, b) of nodes.

    Each round every node takes the smallest label among itself, its neighbours and its label's own
    label; labels are checkpointed each round and the loop stops when none changes.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(nodes.select("node", F.col("node").alias("cluster")))
    for _ in range(rounds):
        of = labels.select(F.col("node").alias("b"), F.col("cluster").alias("_c"))
        least = both.join(of, "b").groupBy(F.col("a").alias("node")).agg(F.min("_c").alias("_m"))
        hooked = labels.join(least, "node", "left").select("node", F.col("cluster").alias("_old"), F.least("cluster", F.coalesce("_m", "cluster")).alias("cluster"))
        above = hooked.select(F.col("node").alias("_n"), F.col("cluster").alias("_up"))
        jumped = hooked.join(above, hooked["cluster"] == above["_n"], "left").select("node", "_old", F.coalesce("_up", "cluster").alias("cluster"))
        new = checkpointed(jumped)
        changed = not new.where("cluster <> _old").isEmpty()
        labels = new.select("node", "cluster")
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


def cluster_items(items: Column, touches: Callable[[Column, Column], Column]) -> Column:
    """Clusters (arrays) of an array's items: the transitive closure of touches(a, b), as a fold.

    Each item joins the clusters that it touches into one. For groups that fit an array, such as
    the boxes of a frame: no join, no rounds, and usable in a stream. Null or empty items: none.
    """

    def add(found: Column, item: Column) -> Column:
        def near(c: Column) -> Column:
            return F.exists(c, lambda other: touches(other, item))

        joined = F.concat(F.flatten(F.filter(found, near)), F.array(item))
        return F.concat(F.filter(found, lambda c: ~near(c)), F.array(joined))

    return F.aggregate(items, F.filter(F.array(items), lambda c: F.lit(False)), add)


def cluster_groups(df: DataFrame, by: list[str], touches: Callable[[Column, Column], Column], key: str = "det_id") -> DataFrame:
    """node and cluster (the smallest member) of every row of groups that fit an array; items have all columns of df."""
    of = df.groupBy(*by).agg(F.collect_list(F.struct(key, *[c for c in df.columns if c != key])).alias("_items"))
    own = of.select(F.explode(cluster_items(F.col("_items"), touches)).alias("_c"))
    nodes = F.transform("_c", lambda m: m[key])
    return own.select(F.explode(nodes).alias("node"), F.array_min(nodes).alias("cluster"))
