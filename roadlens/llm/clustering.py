"""Exact centroid clustering of vectors over subvector dictionaries.

Vectors of integers are cut into blocks of WIDTH dimensions. A chunk of rows holds, for each block,
a dictionary of the block's distinct subvectors and each row's code in it, so nothing is lost. In
a round the exact squared distances of every dictionary entry to every centroid are computed once; a
row's distance is the sum of those of its codes. Sums for the new centroids come from the codes as
well: an entry counts as often as rows of a cluster hold its code.

A dictionary belongs to a chunk, as those of columnar files do: its size is bounded by the chunk,
chunks are encoded where they are read, and a round moves no vector, only one row of exact sums for each
chunk and cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, scratch, ship, table

#: Dimensions of a block.
WIDTH = 2
#: Largest absolute value of an integer component: squared distances of any dimension up to 2^8 fit a long.
MOST = 1 << 26
_CHUNK = "n long, ids binary, nulls binary, codes binary, sizes binary, entries binary"


def whole_components(vector: Column, dim: int) -> Column:
    """Whether a vector has exactly dim components, none of them null or non-finite."""
    inside = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & inside


def _encode(dim: int):
    """Rows (key, components) as chunks; see _decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0)
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            codes, sizes, entries = [], [], []
            for start in range(0, dim, WIDTH):
                block = v[:, start : start + WIDTH]
                order = np.lexsort(block.T)
                ranked = block[order]
                new = np.ones(len(block), bool)
                new[1:] = (ranked[1:] != ranked[:-1]).any(1)
                code = np.empty(len(block), np.int32)
                code[order] = np.cumsum(new) - 1
                codes.append(code)
                sizes.append(int(new.sum()))
                entries.append(ranked[new].ravel())
            row = (
                len(v), key.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes(), key.is_null().to_numpy(zero_copy_only=False).tobytes(),
                np.concatenate(codes).tobytes(), np.array(sizes, np.int64).tobytes(), np.concatenate(entries).tobytes(),
            )
            kinds = (pa.int64(), *[pa.binary()] * 5)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

    return run


def _decoded(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """ids, nulls (where the id is null) and the blocks (first dimension, codes, entries) of each chunk."""
    for batch in batches:
        for n, ids, nulls, codes, sizes, entries in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            code = np.frombuffer(codes, np.int32).reshape(-1, n)
            entry, at, blocks = np.frombuffer(entries, np.int64), 0, []
            for k, size in enumerate(np.frombuffer(sizes, np.int64)):
                width = min(WIDTH, dim - k * WIDTH)
                blocks.append((k * WIDTH, code[k], entry[at : at + size * width].reshape(size, width)))
                at += size * width
            yield np.frombuffer(ids, np.int64), np.frombuffer(nulls, bool), blocks


def _nearest(blocks: list, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and the squared distance of each row of a chunk."""
    total = 0
    for first, code, entry in blocks:
        apart = entry[:, None, :] - centroids[None, :, first : first + entry.shape[1]]
        total = total + (apart * apart).sum(2)[code]
    best = total.argmin(1)
    return best, total[np.arange(len(best)), best]


def first_centroids(kept: DataFrame, k: int) -> list[list[int]]:
    """Components v of the k rows with the smallest sha256 of `1:<_key>`, ties by components; rows with a null _key last."""
    h = F.sha2(F.concat(F.lit("1:"), F.col("_key").cast("string")).cast("binary"), 256)
    rows = kept.select(h.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()  # k rows
    return [list(r["v"]) for r in rows]


def centroid_clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, list[list[int]]]:
    """(key, cluster, distance) of every kept row as a durable table, and the final centroids.

    Kept are rows whose vector has exactly dim components, none null or non-finite; a component x
    becomes floor(scale * x). The first centroids are those of first_centroids; with fewer than k rows
    there are as many centroids as rows. In each of `rounds` rounds every row goes to its nearest
    centroid (squared Euclidean distance, ties to the smaller number), then every centroid with rows
    becomes the floor of their mean in each component; one without rows stays. Rows are then assigned once more.

    Rows that repeat are rows of their own, a null key stays null. No kept rows: no rows, no centroids.
    A component beyond MOST raises an error, as distances would not fit a long.
    """
    spark = vectors.sparkSession
    ship(spark)
    with scratch() as keep:
        own = vectors.select(F.col(f"`{key}`").cast("long").alias("_key"), F.col(f"`{vector}`").alias("_v")).where(whole_components(F.col("_v"), dim))
        scaled = F.transform("_v", lambda x: x.cast("double") * scale)
        beyond = F.raise_error(F.lit(f"a component is beyond {MOST} when scaled")).cast("long")
        kept = own.select("_key", F.transform(scaled, lambda x: F.when(F.abs(x) <= MOST, F.floor(x)).otherwise(beyond)).alias("v"))
        chunks = durable(kept.mapInArrow(_encode(dim), _CHUNK), "chunks")
        centroids = np.array(first_centroids(kept, k), np.int64).reshape(-1, dim)
        for _ in range(rounds if len(centroids) else 0):
            centroids = _moved(chunks, centroids, dim)
        return keep(durable(_assigned(chunks, centroids, dim, key), "assigned")), centroids.tolist()


def _moved(chunks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """Floors of the means of each centroid's rows; one row a cluster reaches the driver."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, blocks in _decoded(batches, dim):
            best, _ = _nearest(blocks, centroids)
            sums = np.empty((k, dim), np.int64)
            for first, code, entry in blocks:
                held = np.bincount(best * len(entry) + code, minlength=k * len(entry)).reshape(k, -1)
                sums[:, first : first + entry.shape[1]] = held @ entry
            count = np.bincount(best, minlength=k)
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(count[at], pa.int64()), pa.array(sums[at].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "s"])

    parts = chunks.mapInArrow(run, "cluster int, n long, s array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(dim)]).alias("s")).collect()
    out = centroids.copy()
    for row in whole:
        out[row["cluster"]] = [total // row["n"] for total in row["s"]]
    return out


def _assigned(chunks: DataFrame, centroids: np.ndarray, dim: int, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, nulls, blocks in _decoded(batches, dim):
            best, distance = _nearest(blocks, centroids)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=nulls), pa.array(best, pa.int32()), pa.array(distance, pa.int64())], ["_key", "cluster", "distance"])

    return chunks.mapInArrow(run, "_key long, cluster int, distance long").withColumnRenamed("_key", key)


def op13_centroid_dictionaries(spark, sf_dir: str) -> DataFrame:
    rows, centroids = centroid_clusters(table(spark, sf_dir, "embeddings"))
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # 16 rows at most
    facts = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, s in sums.items()]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round_sql(k: int, source: str) -> str:
    """CTEs a{k} (rows assigned to the centroids of `source`) and c{k + 1} (centroids moved)."""
    return f"""
a{k} AS (
  SELECT r, vec_id, v, c, d FROM (
    SELECT kept.r, kept.vec_id, kept.v, p.c, list_sum(list_transform(list_zip(kept.v, p.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d,
      row_number() OVER (PARTITION BY kept.r ORDER BY list_sum(list_transform(list_zip(kept.v, p.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), p.c) AS place
    FROM kept, {source} p
  ) WHERE place = 1
), m{k} AS (
  SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k}, range(1, 65) t(i) GROUP BY c, i
), c{k + 1} AS (
  SELECT p.c, coalesce(x.w, p.w) AS w FROM {source} p
  LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS w FROM m{k} GROUP BY c) x ON x.c = p.c
)"""


OP13_SQL = f"""
WITH kept AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, v) - 1 AS c, v AS w FROM kept QUALIFY c < 16
), {_round_sql(0, "c0")}, {_round_sql(1, "c1")}, {_round_sql(2, "c2")}, {_round_sql(3, "c3")}
SELECT a3.vec_id, CAST(a3.c AS INTEGER) AS cluster, CAST(a3.d AS BIGINT) AS distance,
  CAST(sum(a3.d) OVER (PARTITION BY a3.c) AS BIGINT) AS cluster_inertia, CAST(sum(a3.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c3.w, ',')) AS centroid_sha256
FROM a3 JOIN c3 ON a3.c = c3.c
"""
