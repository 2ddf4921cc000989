"""Joint fits against MLlib's and against all pairs."""

import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from roadlens.operators import joins, ml


def objective(x, y, w, b, c=1.0):
    return np.maximum(0, 1 - y * (x @ w - b)).mean() + w @ w / (2 * c * len(x))


def test_models_of_one_pass_reach_what_single_fits_reach(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 5)) * [1, 10, 0.1, 3, 0] + [0, 3, 0, 0, 2]
    label = (np.abs(x[:, 1]) + 4 * x[:, 0] > 8).astype(int) + (x[:, 3] > 2)
    df = spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x, strict=True)], "label long, features array<double>").repartition(3).cache()
    parts = {"all": F.lit(True), "some": F.col("features")[0] > -0.5, "none": F.lit(False)}
    found = {m[:2]: m[2:] for m in ml.fit_classes(df, parts, [0, 1, 2], 1.0)}
    assert set(found) == {(p, k) for p in parts for k in range(3)}
    for (part, k), (w, b) in found.items():
        on = {"all": x[:, 0] < np.inf, "some": x[:, 0] > -0.5, "none": x[:, 0] == np.inf}[part]
        if part == "none":
            assert not any(w) and b == 0
            continue
        own, y = x[on], np.where(label[on] == k, 1, -1)
        rows = df.where(parts[part]).select((F.col("label") == k).cast("double").alias("label"), array_to_vector("features").alias("features"))
        single = LinearSVC(maxIter=10, regParam=1 / len(own), standardization=False).fit(rows)
        assert objective(own, y, np.array(w), b) <= 1.02 * objective(own, y, single.coefficients.toArray(), -single.intercept) + 1e-3


def test_a_rank_model_of_rows_is_that_of_all_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-20, 20, (150, 4))
    rows = [(i, i % 3, int(x[i, 0] * 2 + rng.integers(0, 25)) // 20, x[i].tolist()) for i in range(150)] + [(900, None, 1, [1] * 4), (901, 1, None, [1] * 4), (902, 8, 1, [1] * 4)]
    df = spark.createDataFrame(rows, "id long, qid long, rank int, q array<long>").repartition(3).cache()
    w = np.array([0.05, -0.01, 0.02, 0.0])
    kept = [r for r in rows if r[1] is not None and r[2] is not None]
    score = {r[0]: float(np.dot(r[3], w)) for r in kept}
    scored = spark.createDataFrame([(r[0], r[1], r[2], score[r[0]]) for r in kept], "id long, qid long, rank int, s double")
    got = {r["id"]: r for r in ml.pair_forces(scored, sorted({r[2] for r in kept})).collect()}
    pairs = [(a, b) for a in kept for b in kept if a[1] == b[1] and a[2] < b[2]]
    short = [(a[0], b[0], 1 - (score[b[0]] - score[a[0]])) for a, b in pairs if score[b[0]] < score[a[0]] + 1]
    assert abs(sum(r["loss"] for r in got.values()) - sum(s for *_, s in short)) < 1e-6
    assert {i: r["lift"] for i, r in got.items()} == {r[0]: sum(a == r[0] for a, *_ in short) - sum(b == r[0] for _, b, _ in short) for r in kept}
    diff = np.array([np.subtract(b[3], a[3]) for a, b in pairs])
    assert joins.rank_pairs(df).count() == len(diff)
    one, two = np.array(ml.rank_model_of(df)), np.array(ml.rank_model(joins.rank_pairs(df)))
    up = np.ones(len(diff))
    assert objective(diff, up, one, 0) <= 1.02 * objective(diff, up, two, 0) < 0.9
    assert ml.rank_model_of(df.where("rank = 1")) == []


def test_distances_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(i), int(i) % 2, int(rng.integers(0, 3)), rng.integers(-9, 9, 3).tolist()) for i in rng.permutation(120)]
    rows += [(200, 0, 1, None), (201, 0, 2, [1, None, 3]), (202, 0, 0, [4, 5]), (203, 0, 2, [2**40, 1]), (204, None, 1, [1, 2, 3]), (205, 1, None, [1, 2, 3]), (206, 5, 1, [1, 2, 3]), (3, 1, 7, [0, 0, 0]), (207, 0, 1, []), (208, 0, 2, [])]
    df = spark.createDataFrame(rows, "id long, qid long, rank int, q array<long>").repartition(3)
    want = joins.rank_pairs(df).select("qid", "a", "b", "target", F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + F.abs(x)).alias("l1"))
    want = sorted(map(tuple, want.collect()), key=repr)
    for size in (8192, 7):
        monkeypatch.setattr(joins, "BLOCK_ROWS", size)
        assert sorted(map(tuple, joins.rank_distances(df).collect()), key=repr) == want
    assert any(r[4] is None for r in want)
