"""Whitening of embeddings by QDWH spectral divide-and-conquer.

Tasks sum integer vectors and products of vectors centred on the rounded mean; what the rounding
leaves is taken off in whole numbers, so the covariance is that of exact arithmetic. It is as large as
the dimension alone and is split on the driver: the unitary polar factor of the covariance minus a
shift (dynamically weighted Halley iterations) gives the spectral projector of the eigenvalues above
the shift, whose range and its complement are invariant subspaces; these are split in turn until each is
one component. The components, of fixed size, go to the tasks that whiten.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .clustering import whole_components
from .common import ship, table

EPS = float(np.finfo(float).eps)
#: Largest absolute integer component: exact products of centred vectors fit a long.
MOST = 1 << 30
#: Rows that a task whitens at a time.
SLICE = 1024


def polar(a: np.ndarray) -> np.ndarray:
    """Unitary polar factor of a symmetric matrix by QR- and Cholesky-based dynamically weighted Halley iterations."""
    n = len(a)
    norm = np.linalg.norm(a)
    if norm == 0:
        return np.eye(n)
    x = a / norm
    low = max(EPS, float(np.linalg.norm(np.linalg.inv(x), 1)) ** -1 / np.sqrt(n)) if np.linalg.cond(x, 1) < 1 / EPS else EPS
    low = min(low, 1.0)
    for _ in range(20):
        g = np.cbrt(4 * (1 - low * low) / low**4)
        h = np.sqrt(1 + g) + 0.5 * np.sqrt(max(0.0, 8 - 4 * g + 8 * (2 - low * low) / (low * low * np.sqrt(1 + g))))
        b = (h - 1) ** 2 / 4
        c = h + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, np.eye(n)]))
            new = b / c * x + (h - b / c) / np.sqrt(c) * (q[:n] @ q[n:].T)
        else:
            w = np.linalg.cholesky(np.eye(n) + c * (x.T @ x))
            new = b / c * x + (h - b / c) * np.linalg.solve(w.T, np.linalg.solve(w, x.T)).T
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x), new
        low = min(1.0, low * (h + b * low * low) / (1 + c * low * low))
        if moved < np.cbrt(5 * EPS) and abs(1 - low) < 10 * EPS:
            break
    return x


def _split(a: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces above and below a shift, None where no shift separates eigenvalues."""
    n = len(a)
    spread = np.linalg.norm(a - np.trace(a) / n * np.eye(n))
    if spread <= 4 * n * EPS * scale:
        return None
    draw = np.random.default_rng(n).standard_normal((n, n))
    mean, diagonal = np.trace(a) / n, np.diag(a)
    best = None
    # the middle of the diagonal splits evenly; the mean has eigenvalues on both sides whenever they differ
    for shift in (np.median(diagonal), mean, mean + spread / (2 * n), mean - spread / (2 * n), (diagonal.max() + diagonal.min()) / 2):
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(float(np.trace(p))))
        if not 0 < k < n:
            continue
        q, _ = np.linalg.qr(p @ (p @ draw[:, :k]), mode="complete")
        q[:, :k], _ = np.linalg.qr(p @ q[:, :k])
        q, _ = np.linalg.qr(q)
        off = np.linalg.norm(q[:, k:].T @ a @ q[:, :k])
        if best is None or off < best[0]:
            best = off, q[:, :k], q[:, k:]
        if off <= 8 * n * EPS * scale:
            break
    return best and best[1:]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by spectral divide-and-conquer."""
    n, scale = len(a), float(np.linalg.norm(a))
    done, open_ = [], [np.eye(n)]
    while open_:
        basis = open_.pop()
        own = basis.T @ a @ basis
        own = (own + own.T) / 2
        parts = _split(own, scale) if len(own) > 1 else None
        if parts is None:
            done.append(basis)  # one component, or eigenvalues that do not differ
        else:
            open_ += [basis @ x for x in parts]
    vectors = _refined(a, np.hstack(done)) if done else np.eye(n)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _refined(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x after two Newton corrections towards the eigenvectors it is near to: those of well-separated values gain the last digits."""
    norm = np.linalg.norm(a)
    for _ in range(2):
        r, s = np.eye(len(a)) - x.T @ x, x.T @ a @ x
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > 1e-6 * norm
        with np.errstate(divide="ignore", invalid="ignore"):
            e = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1), r / 2)
        x = x + x @ e
    return x


def _sums(dim: int, centre: np.ndarray | None):
    """Exact sums of integer vectors, or of the products of vectors minus centre, of each task: rows (i, s)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((1 if centre is None else dim + 1, dim), np.int64), 0
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            n += len(x)
            if centre is None:
                total[0] += x.sum(0)
                continue
            z = x - centre
            total[dim] += z.sum(0)
            rows = max(1, int(2.0**53 / max(1.0, float(np.abs(z).max(initial=0)) ** 2)))  # as many as doubles add up exactly
            for start in range(0, len(z), rows):
                part = z[start : start + rows].astype(float)
                total[:dim] += (part.T @ part).astype(np.int64) if rows > 1 else z[start : start + 1].T @ z[start : start + 1]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array(total.tolist(), pa.list_(pa.int64()))], ["i", "n", "s"])

    return run


def _collected(x: DataFrame, dim: int, centre: np.ndarray | None) -> tuple[int, np.ndarray]:
    """Number of rows and the sums over all of them, as Python integers; as many reach the driver as the dimension has squares."""
    parts = x.mapInArrow(_sums(dim, centre), "i int, n long, s array<long>").select("i", "n", F.posexplode("s").alias("j", "v"))
    # decimals hold what may pass a long
    rows = parts.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    out = np.zeros((1 if centre is None else dim + 1, dim), object)
    for r in rows:
        out[r["i"], r["j"]] = int(r["v"])
    return (rows[0]["n"] if rows else 0), out


def covariance(x: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of rows n, sums S and the covariance (divisor n) of integer vectors x (second column)."""
    n, sums = _collected(x, dim, None)
    if not n:
        return 0, sums[0], np.zeros((dim, dim))
    s = sums[0]
    centre = np.array([(2 * v + n) // (2 * n) for v in s], np.int64)
    _, products = _collected(x, dim, centre)
    rest = products[dim]
    # the mean of the centred vectors is below one; n times the products minus its own are whole numbers
    return n, s, np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(dim)] for i in range(dim)])


def components(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues, those of no variance left out, and their eigenvectors as columns."""
    values, vectors = eigen(cov)
    kept = int((values > len(cov) * 16 * EPS * max(values.max(initial=0.0), 0.0)).sum())
    kept = min(kept, most) if values.max(initial=0.0) > 0 else 0
    return values[:kept], vectors[:, :kept]


def _whitened(batch_x: np.ndarray, n: int, s: np.ndarray, loads: np.ndarray) -> np.ndarray:
    """(x - S / n) on each load: n * x - S is a whole number that doubles hold, or nearly."""
    return ((n * batch_x - s) / n) @ loads


def whiten(vectors: DataFrame, most: int = 32, scale: int = 64, offset: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, component, n, deviation, whitened, explained and identity_error, a row for each vector and component.

    Vectors that are null or hold null or non-finite entries take no part, nor do empty ones, which
    have no components. An entry c becomes x = floor(scale * c) + offset; n vectors have sums S. The
    components are unit eigenvectors of x's covariance by falling eigenvalue e, `most` of them at
    most; whitened is (x - S / n) projected on the component, over sqrt(e); explained is e over the
    covariance's trace; deviation is the exact sum of (n * x - S)^2; identity_error is the largest absolute
    entry of whitened's covariance minus the identity, as measured on the values returned. Components
    without variance, which cannot be whitened, have no rows; so a single vector, or equal ones, give none.

    Vectors of each dimension are a list of their own. Rows that repeat are rows of their own; a null
    key stays null. Entries beyond MOST raise an error, as does a deviation beyond a long. No rows: no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_v")).where(whole_components(F.col("_v"), F.size("_v")) & (F.size("_v") > 0))
    scaled = F.transform("_v", lambda x: x.cast("double") * scale)
    beyond = F.raise_error(F.lit(f"an entry is beyond {MOST} when scaled")).cast("long")
    own = own.select("_key", F.transform(scaled, lambda x: F.when(F.abs(x) <= MOST, F.floor(x) + offset).otherwise(beyond)).alias("x"))
    key_type = vectors.schema[key].dataType.simpleString()
    dims = sorted(r["d"] for r in own.select(F.size("x").alias("d")).distinct().collect())  # the few dimensions that occur
    out = spark.createDataFrame([], f"_key {key_type}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for dim in dims:
        out = out.unionByName(_whiten_list(own.where(F.size("x") == dim), dim, most))
    return out.withColumnRenamed("_key", key)


def _whiten_list(x: DataFrame, dim: int, most: int) -> DataFrame:
    n, s, cov = covariance(x, dim)
    values, vectors = components(cov, most)
    loads, k = vectors / np.sqrt(values), len(values)
    sums = s.astype(np.int64)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            all_x = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            for start in range(0, len(all_x), SLICE):
                w = _whitened(all_x[start : start + SLICE], n, sums, loads)
                total[:k] += w.T @ w
                total[k] += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(range(k + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "s"])

    measured = np.zeros((k + 1, k))
    parts = x.mapInArrow(moments, "i int, s array<double>").select("i", F.posexplode("s").alias("j", "v"))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        measured[r["i"], r["j"]] = r["v"] / n
    error = float(np.abs(measured[:k] - np.outer(measured[k], measured[k]) - np.eye(k)).max(initial=0.0))
    explained = [float(v / np.trace(cov)) for v in values]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = np.arange(1, k + 1, dtype=np.int32)
        for batch in batches:
            all_x = batch.column(2).flatten().to_numpy().reshape(-1, dim)
            for start in range(0, len(all_x) if k else 0, SLICE):
                own = all_x[start : start + SLICE]
                w, at = _whitened(own, n, sums, loads), np.repeat(np.arange(start, start + len(own)), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at)), pa.array(np.tile(numbers, len(own))), batch.column(1).take(pa.array(at)), pa.array(w.ravel())],
                    ["_key", "component", "deviation", "whitened"],
                )

    from_mean = F.transform(F.arrays_zip("x", F.array(*[F.lit(int(v)) for v in s]).alias("s")), lambda p: F.lit(n) * p["x"] - p["s"])
    ready = x.select("_key", F.aggregate(from_mean, F.lit(0).cast("long"), lambda a, y: a + y * y).alias("deviation"), "x")
    made = ready.mapInArrow(project, f"_key {x.schema['_key'].dataType.simpleString()}, component int, deviation long, whitened double")
    share = F.element_at(F.array(*[F.lit(e) for e in explained]), F.col("component")) if explained else F.lit(0.0)
    return made.select("_key", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whiten_qdwh(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
