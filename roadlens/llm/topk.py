"""Exact top-k inner-product search by norm-bucketed retrieval.

Vectors are grouped by length. A query's k-th best score among a bounded set of long vectors is
a lower bound t for its final k-th score. In a bucket whose longest vector has length m only
vectors whose cosine with the query is at least t / (|q| m) can matter: above 1 the bucket is
skipped; where it is high, intervals of the query's largest coordinates leave few candidates;
where it is low, vectors are cut by length alone. What is left is verified by whole products.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clustering import whole_components
from .common import durable, ship, table

#: Length classes; rows of a block of candidates and of queries, about; long vectors for first bounds.
CLASSES, BLOCK_ROWS, QUERY_ROWS, SEEDS = 16, 4096, 1024, 1024
#: Local cosine threshold from which coordinates prune, and how many coordinates are looked at.
COSINE, FOCUS = 0.6, 4
#: Largest absolute value of a component as a whole number: products of up to 2^8 of them fit a long.
MOST = 1 << 27
_PREPARED = "vec_id long, dim int, length double, v binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (vec_id, whole components) with their dimension, length and components as bytes."""
    for batch in batches:
        at, values = batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()
        parts = [values[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
        length = [float(np.linalg.norm(p.astype(np.float64))) for p in parts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(at), pa.int32()), pa.array(length, pa.float64()), pa.array([p.tobytes() for p in parts], pa.binary())],
            ["vec_id", "dim", "length", "v"],
        )


def _matrix(rows: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(rows), np.int64).reshape(-1, dim)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point only where that is exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return (q.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64) if most < 2.0**53 else q @ x.T


def search_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """For each query (vec_id, dim, length, v, bound) its at most k best of rows that reach its bound."""
    out: list[tuple] = []
    rows = rows.sort_values("length", ascending=False, kind="stable")
    for dim, own in rows.groupby("dim", sort=False):
        asked = queries[queries["dim"] == dim]
        if not len(asked):
            continue
        x, ids, length = _matrix(own["v"], dim), own["vec_id"].to_numpy(), own["length"].to_numpy()
        q, q_ids, q_length, bound = _matrix(asked["v"], dim), asked["vec_id"].to_numpy(), asked["length"].to_numpy(), asked["bound"].to_numpy()
        slack = 1e-9
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(bound > 0, bound / (q_length * max(length[0], 1e-300)), -1.0)
        alive = np.flatnonzero(~(cosine > 1 + slack))
        by_length = alive[cosine[alive] < COSINE]
        reach = np.full(len(q), len(x))
        positive = by_length[bound[by_length] > 0]
        shortest = bound[positive] / q_length[positive] * (1 - slack)
        reach[positive] = np.searchsorted(-length, -shortest, "right")
        for part in np.array_split(by_length[np.argsort(reach[by_length])], max(1, len(by_length) // 64)):
            if len(part):
                n = reach[part].max()
                scores = _products(q[part], x[:n])
                for i, row in zip(part, scores, strict=True):
                    _best(out, q_ids[i], bound[i], ids[: reach[i]], row[: reach[i]], k)
        unit = x / np.maximum(length, 1e-300)[:, None]
        for i in alive[cosine[alive] >= COSINE]:
            direction = q[i] / q_length[i]
            c = min(1.0, cosine[i]) * (1 - slack)
            mask = length >= bound[i] / q_length[i] * (1 - slack)
            for f in np.argsort(-np.abs(direction))[:FOCUS]:
                half = np.sqrt(max(0.0, 1 - direction[f] ** 2) * max(0.0, 1 - c * c)) + slack
                low, high = direction[f] * c - half, 1.0 if direction[f] >= c else direction[f] * c + half
                low = -1.0 if direction[f] <= -c else low
                mask &= (unit[:, f] >= low - slack) & (unit[:, f] <= high + slack)
            at = np.flatnonzero(mask)
            _best(out, q_ids[i], bound[i], ids[at], _products(q[i : i + 1], x[at])[0], k)
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


def _best(out: list, query: int, bound: float, ids: np.ndarray, scores: np.ndarray, k: int) -> None:
    keep = np.flatnonzero((scores >= bound) & (ids != query))
    if len(keep) > k:
        keep = keep[np.lexsort((ids[keep], -scores[keep]))[:k]]
    out += [(query, i, s) for i, s in zip(ids[keep].tolist(), scores[keep].tolist(), strict=True)]


class Blocks:
    """Which blocks of candidates meet which groups of queries.

    Classes hold ever longer vectors; a class has blocks of about BLOCK_ROWS rows. A query whose k-th score
    is t or more needs vectors of length t / |q| at least, so only blocks from some class on; groups of about
    QUERY_ROWS queries have that least class in common, so neither side is copied for pairs that cannot matter.
    """

    def __init__(self, sizes: dict[int, tuple[int, float]]):
        self.classes = sorted(sizes)
        self.longest = {c: sizes[c][1] for c in self.classes}
        self.parts = {c: max(1, ceil(sizes[c][0] / BLOCK_ROWS)) for c in self.classes}
        self.first = {c: sum(self.parts[d] for d in self.classes if d < c) for c in self.classes}
        self.n_blocks = sum(self.parts.values())
        self.count: dict[int, int] = {}
        self.begin: dict[int, int] = {}

    def least_class(self, bound: Column, length: Column) -> Column:
        """The first class with a vector long enough; null where there is none."""
        reach = [F.when(bound <= length * float(self.longest[c]) * (1 + 1e-9), F.lit(c)) for c in self.classes]
        return F.coalesce(F.when(bound == float("-inf"), F.lit(min(self.classes, default=0))), *reach)

    def group(self, queries: dict[int, int]) -> None:
        """Groups for so many queries by their least class, numbered in the order of the classes."""
        self.count = {c: max(1, ceil(n / QUERY_ROWS)) for c, n in queries.items()}
        self.begin = {c: sum(n for d, n in self.count.items() if d < c) for c in self.count}

    def _of(self, table: dict[int, int], key: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key) if table else F.lit(None).cast("int")

    def block(self) -> Column:
        c = F.col("_class")
        return (self._of(self.first, c) + F.pmod(F.xxhash64("vec_id"), self._of(self.parts, c))).cast("int")

    def groups_of_class(self) -> Column:
        """Groups whose queries may need a candidate of class _class: the first ones."""
        upto = {c: sum(n for d, n in self.count.items() if d <= c) for c in self.classes}
        n = F.coalesce(self._of(upto, F.col("_class")), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    def query_group(self) -> Column:
        c = F.col("_least")
        return (self._of(self.begin, c) + F.pmod(F.xxhash64("vec_id"), self._of(self.count, c))).cast("int")

    def blocks_of_query(self) -> Column:
        return F.sequence(F.coalesce(self._of(self.first, F.col("_least")), F.lit(0)), F.lit(max(1, self.n_blocks) - 1))


def top_k(vectors: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows but itself (all, if fewer).

    Vectors that are null or hold null or non-finite components, and rows with a null key, take
    no part. Only vectors of one dimension are compared. Ties go to the smaller vec_id. A key
    that repeats is never a result of its own query. No queries or no rows: no result. A component
    beyond MOST raises an error, as products would not fit a long.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("_v")).where(F.col("vec_id").isNotNull() & whole_components(F.col("_v"), F.size("_v")))
    beyond = F.raise_error(F.lit(f"a component is beyond {MOST} when scaled")).cast("long")
    scaled = F.transform(F.transform("_v", lambda x: x.cast("double") * 1024), lambda x: F.when(F.abs(x) <= MOST, F.floor(x)).otherwise(beyond))
    ready = durable(own.select("vec_id", scaled.alias("_v")).mapInArrow(_prepare, _PREPARED), "vectors")
    seeds = ready.orderBy(F.col("length").desc(), "vec_id").limit(SEEDS).toPandas()  # bounded by SEEDS
    held = spark.sparkContext.broadcast(seeds)

    def first_bounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in batches:
            found = search_block(asked.assign(bound=-np.inf), held.value, k)
            worst = found.groupby("query_id")["score"].agg(["size", "min"])
            worst = worst["min"].where(worst["size"] >= k)
            yield asked.assign(bound=asked["vec_id"].map(worst).astype(float).fillna(-np.inf))

    queries = durable(ready.where(is_query(F.col("vec_id"))).dropDuplicates(["vec_id", "v"]).mapInPandas(first_bounds, _PREPARED + ", bound double"), "queries")
    edges = sorted(ready.approxQuantile("length", [i / CLASSES for i in range(1, CLASSES)], 0.01)) if not ready.isEmpty() else []
    in_class = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e < F.col("length"))) if edges else F.lit(0)
    classed = ready.withColumn("_class", in_class)
    sizes = {r["_class"]: (r["n"], r["longest"]) for r in classed.groupBy("_class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}  # CLASSES rows
    plan = Blocks(sizes)
    queries = queries.withColumn("_least", plan.least_class(F.col("bound"), F.col("length")))
    plan.group({r["_least"]: r["count"] for r in queries.where("_least is not null").groupBy("_least").count().collect()})
    # blocks of candidates meet blocks of the stated queries, but for those that no bound reaches
    left = classed.withColumn("block", plan.block()).withColumn("group", F.explode(plan.groups_of_class())).drop("_class")
    right = queries.where("_least is not null").withColumn("group", plan.query_group()).withColumn("block", F.explode(plan.blocks_of_query())).drop("_least")

    def pair(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return search_block(asked, rows, k)

    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInPandas(pair, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_norm_buckets(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 100 == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.c, x.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id AND len(q.c) = len(x.c)
  WHERE q.vec_id % 100 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
