"""Hierarchical weighted hash tree: region, rack and shard levels.

Every node of a level draws -ln(u) / weight for a key, with u a hash of key and node in (0, 1);
the smallest draw wins and the next level is descended there. A node's weight is the sum of
its shards' weights. A node's draw does not depend on its siblings, so changing one subtree's
weight moves keys only into or out of that subtree.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import packed, rest_columns, table

#: Rows that one slot bucket holds on average.
BUCKET_ROWS = 512
SHARDS_PER_RACK, RACKS_PER_REGION = 4, 2


@dataclass(frozen=True)
class Shard:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def layout(n_shards: int, weights: dict[int, float] | None = None) -> list[Shard]:
    """Shards filled rack by rack, racks region by region."""
    per_region = SHARDS_PER_RACK * RACKS_PER_REGION
    return [Shard(s, s // SHARDS_PER_RACK, s // per_region, (weights or {}).get(s, 1.0)) for s in range(n_shards)]


def grown(tree: list[Shard]) -> list[Shard]:
    """tree with one more shard, in a rack and a region of its own: the keys that move all go to it.

    In a region that exists it would change that region's weight, and so draw keys to its older shards too.
    """
    return [*tree, Shard(max((s.shard for s in tree), default=-1) + 1, max((s.rack for s in tree), default=-1) + 1, max((s.region for s in tree), default=-1) + 1)]


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), node), 11).cast("double") + 0.5) * (2.0**-53)
    return -F.log(u) / weight


def _descend(key: Column, level: str, children: Column) -> Column:
    """Id of the child with the smallest draw; the smaller id on a tie."""
    drawn = F.transform(children, lambda c: F.struct(_draw(key, level, c["id"], c["w"]).alias("d"), c["id"].alias("id")))
    return F.array_min(drawn)["id"]


def _family(tree: list[Shard], parent: str | None, child: str) -> Column:
    """Map from a parent's id to its children's ids and weights; shards of weight 0 take nothing."""
    of: dict[int, dict[int, float]] = {}
    for s in tree:
        if s.weight > 0:
            own = of.setdefault(getattr(s, parent) if parent else 0, {})
            own[getattr(s, child)] = own.get(getattr(s, child), 0.0) + s.weight
    arrays = []
    for p in sorted(of):
        arrays += [F.lit(p), F.array(*[F.struct(F.lit(c).alias("id"), F.lit(w).alias("w")) for c, w in sorted(of[p].items())])]
    return F.create_map(*arrays)


def shard_of(key: Column, tree: list[Shard]) -> Column:
    """Shard of a key. A null key is a key like any other and gets one fixed shard."""
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    bind = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    rack = lambda region: _descend(key, "rack", _family(tree, "region", "rack")[region])
    shard = lambda r: _descend(key, "shard", _family(tree, "rack", "shard")[r])
    return bind(bind(_descend(key, "region", _family(tree, None, "region")[F.lit(0)]), rack), shard)


def with_slots(df: DataFrame, group: str, order: list[str], n_rows: int, n_groups: int, slot: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each group, in tasks of bounded size.

    Rows are dealt into hash buckets of a group (about BUCKET_ROWS rows each, so a group that
    holds most rows spreads over many tasks), numbered there, and moved by the sizes of the
    group's earlier buckets. Equal rows get different slots.
    """
    buckets = max(1, ceil(n_rows / max(1, n_groups) / BUCKET_ROWS))
    names, order = order, [f"_o{i}" for i in range(len(order))]
    df = packed(df, [slot], _group_=F.col(f"`{group}`"), **{o: F.col(f"`{c}`") for o, c in zip(order, names, strict=True)})
    out_columns, group = rest_columns(df), "_group_"
    placed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)).cast("int"))
    sizes = placed.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col(group).alias("_group"), F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    within = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = placed.withColumn("_row", F.row_number().over(within))
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bucket") == F.col("_of")))
    return joined.select(*out_columns, (F.col("_start") + F.col("_row") - 1).cast("long").alias(slot))


def shard_rows(df: DataFrame, key: str, n_shards: int = 24, weights: dict[int, float] | None = None) -> DataFrame:
    """df with shard (the tree's) and grown_shard (that of the tree with one more shard, see grown).

    Nulls: a null key is one key. Empty input: empty output. Repeated rows: the same shard.
    Other columns pass through; existing columns named shard or grown_shard are replaced.
    """
    tree = layout(n_shards, weights)
    return df.withColumns({"shard": shard_of(F.col(f"`{key}`"), tree), "grown_shard": shard_of(F.col(f"`{key}`"), grown(tree))})


def op8_shard_hash_tree(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    sharded = shard_rows(rows, "doc_id", 24)
    out = with_slots(sharded, "shard", ["doc_id", "text_crc32", "size"], docs.count(), 24)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
