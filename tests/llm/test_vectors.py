import hashlib

import numpy as np
import pytest

from roadlens.llm import clustering, whitening
from roadlens.llm.common import table

from ..conftest import DATA


def lloyd(rows, k, rounds, scale, dim):
    """Clusters, distances and centroids by plain integer loops; rows are (key, vector)."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    ranked = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in ranked[:k]]

    def assign():
        found = [[(sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids)] for _, v in kept]
        return [min(x) for x in found]

    for _ in range(rounds):
        best = assign()
        for n in range(len(centroids)):
            own = [v for (_, v), (_, b) in zip(kept, best, strict=True) if b == n]
            if own:
                centroids[n] = [sum(column) // len(own) for column in zip(*own, strict=True)]
    return sorted(((i, n, d) for (i, _), (d, n) in zip(kept, assign(), strict=True)), key=repr), centroids


def hard_vectors(dim):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=dim) * 3).round(2).tolist()) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(300, 340)] + [(5, rows[5][1]), (None, rows[6][1]), (None, rows[7][1])]
    rows += [(400, None), (401, [None] * dim), (402, [float("nan")] * dim), (403, [float("inf")] + [0.0] * (dim - 1)), (404, []), (405, [1.0] * (dim + 1)), (406, [0.0] * dim)]
    return rows


def test_clusters_against_plain_lloyd(spark):
    for dim in (5, 6):
        rows = hard_vectors(dim)
        df = spark.createDataFrame([(*r, 1, "n") for r in rows], "vec_id long, embedding array<double>, v long, `a.b` string").repartition(5)
        got, centroids = clustering.centroid_clusters(df, k=7, rounds=4, scale=16, dim=dim)
        want, plain = lloyd(rows, 7, 4, 16, dim)
        assert centroids == plain
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_clusters_of_few_and_no_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "vec_id long, embedding array<double>")
    got, centroids = clustering.centroid_clusters(df, k=16, dim=2)
    assert len(centroids) == 3 and got.where("distance = 0").count() == 3
    got, centroids = clustering.centroid_clusters(df.limit(0), dim=2)
    assert centroids == [] and got.count() == 0
    with pytest.raises(Exception, match="beyond"):
        clustering.centroid_clusters(spark.createDataFrame([(1, [1e30, 0.0])], df.schema), dim=2)


def test_eigen_by_qdwh():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 17, 64):
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        for e in (rng.random(n) * 10, np.ones(n), np.arange(n) // 2 + 1.0, 1000.0 ** -(np.arange(n) / n), np.r_[1000, 1 + 1e-3 * np.arange(n - 1)]):
            a = (q * e) @ q.T
            a = (a + a.T) / 2
            values, x = whitening.eigen(a)
            np.testing.assert_allclose(values, np.sort(e)[::-1], atol=1e-13 * e.max())
            assert np.abs(x.T @ x - np.eye(n)).max() < 1e-11
            assert np.abs(a @ x - x * values).max() < 1e-13 * e.max()
    u = whitening.polar(np.diag([3.0, -1.0, 1e-9, -1e-12]))
    np.testing.assert_allclose(u, np.diag([1, -1, 1, -1]), atol=1e-14)


def expected(vectors, most):
    x = np.floor(64 * np.asarray(vectors, np.float64)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    y = x - s / n
    values, axes = np.linalg.eigh(y.T @ y / n)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), y @ axes / np.sqrt(values), values / np.trace(y.T @ y / n)


def check(rows, ids, vectors, most):
    n, deviation, whitened, explained = expected(vectors, most)
    assert len(rows) == n * whitened.shape[1] and {r["n"] for r in rows} == {n}
    assert len({r["identity_error"] for r in rows}) == 1 and rows[0]["identity_error"] < 1e-9
    got = np.zeros_like(whitened)
    at = {k: i for i, k in enumerate(ids)}
    for r in rows:
        i, c = at[r["vec_id"]], r["component"] - 1
        got[i, c] = r["whitened"]
        assert r["deviation"] == deviation[i] and abs(r["explained"] - explained[c]) < 1e-10
    signs = np.sign((got * whitened).sum(0))
    np.testing.assert_allclose(got * signs, whitened, atol=1e-7)


def test_whitening_of_the_table(spark):
    own = table(spark, DATA, "embeddings").orderBy("vec_id").select("vec_id", "embedding").collect()
    check(whitening.op12_whiten_qdwh(spark, DATA).collect(), [r[0] for r in own], [r[1] for r in own], 32)


def test_whitening_of_hard_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, (rng.normal(size=5) * [9, 5, 3, 2, 1] + 7).tolist()) for i in range(300)]
    good += [(i, good[3][1]) for i in range(300, 340)]
    bad = [(400, None), (401, [None] * 5), (402, [float("nan")] * 5), (403, [float("-inf"), 0.0, 0.0, 0.0, 0.0]), (404, [])]
    schema = "vec_id long, embedding array<double>, x long, `a.b` long, component int"
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in good + bad], schema).repartition(3)
    check(whitening.whiten(df).collect(), [r[0] for r in good], [r[1] for r in good], 5)
    # other dimensions are lists of their own; no variance, no components
    more = spark.createDataFrame([(1000 + i, [float(i), 2.0 * i], 1, 2, 3) for i in range(4)] + [(None, [1.0], 1, 2, 3), (None, [1.0], 1, 2, 3)], schema)
    both = whitening.whiten(df.unionByName(more)).collect()
    check([r for r in both if r["vec_id"] < 1000], [r[0] for r in good], [r[1] for r in good], 5)
    rest = [r for r in both if r["vec_id"] >= 1000]
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in rest) == [(1000 + i, 1, 4) for i in range(4)]
    assert whitening.whiten(df.limit(0)).count() == 0 and whitening.whiten(df.where("vec_id = 0")).count() == 0
