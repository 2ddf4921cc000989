"""Classifier queries take every class of the table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.functions import kernels
from roadlens.operators import ml
from roadlens.operators.windows import folds
from roadlens.plans import learning

from .conftest import DATA


@pytest.mark.parametrize(("query", "job"), [("m2", "cross_validate"), ("m4", "learning_curve"), ("m7", "pca_per_class")])
def test_queries_take_all_rows(spark, monkeypatch, query, job):
    """The job's input, as training all classes takes minutes here."""
    monkeypatch.setattr(learning.op, job, lambda df, *_: df)
    got = getattr(learning, query)(spark, DATA).select("id", "label").collect()
    rows = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "label").collect()
    assert len({r["label"] for r in rows}) > 3
    assert sorted(map(tuple, got)) == sorted(map(tuple, rows))


def blobs(spark, n=240, classes=4, dims=6):
    """Well separated classes with a few samples astray."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(classes, dims)) * 4
    rows = [(i, i % classes, (centres[i % classes] + rng.normal(size=dims) * (0.6 if i % 29 else 6)).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label long, features array<double>").repartition(3).cache()


def test_one_vs_all_separates_classes(spark):
    df = blobs(spark)
    models = ml.train_one_vs_all(df)
    assert sorted(r["class"] for r in models.collect()) == [0, 1, 2, 3]
    scored = ml.score(df, models)
    assert scored.count() == 4 * 240
    best = scored.groupBy("id", "label").agg(F.max_by("class", "score").alias("best"))
    assert best.where("label = best").count() >= 0.9 * 240
    two = ml.train_one_vs_all(df.where("label < 2"))
    assert [r["class"] for r in two.collect()] == [1]
    with pytest.raises(ValueError, match="two classes"):
        ml.train_one_vs_all(df.where("label = 0"))


def test_folds_are_scored_by_models_that_have_not_seen_them(spark):
    df = blobs(spark)
    got = {r["class"]: r for r in ml.cross_validate(df, 3).collect()}
    assert set(got) == {0, 1, 2, 3} and all(r["error"] <= 0.15 for r in got.values())
    # by hand, one fold and class
    own = folds(df, 3)
    errors = []
    for fold in range(3):
        models = ml.train_one_vs_all(own.where(f"fold is null or fold <> {fold}").select("id", "label", "features"))
        errors.append(ml.evaluate(ml.score(own.where(f"fold = {fold}").select("id", "label", "features"), models)).where("class = 2").first()["error"])
    assert abs(sum(errors) / 3 - got[2]["error"]) < 0.02
    curve = ml.learning_curve(df, (0.2, 1.0)).collect()
    assert {(r["share"], r["class"]) for r in curve} == {(s, c) for s in (0.2, 1.0) for c in range(4)}
    assert sum(r["error"] for r in curve if r["share"] == 1.0) <= sum(r["error"] for r in curve if r["share"] == 0.2) + 0.2
    sides = ml.validate(df, 0.75).collect()
    assert {(r["side"], r["class"]) for r in sides} == {(s, c) for s in ("train", "test") for c in range(4)} and max(r["error"] for r in sides) <= 0.15


def test_pair_models_and_pca(spark):
    df = blobs(spark)
    pairs = {(r["c1"], r["c2"]): r for r in ml.pair_models(df).collect()}
    assert set(pairs) == {(a, b) for a in range(4) for b in range(a + 1, 4)}
    rows = df.collect()
    for (a, b), m in pairs.items():
        right = [(np.dot(r["features"], m["w"]) - m["b"] > 0) == (r["label"] == a) for r in rows if r["label"] in (a, b)]
        assert np.mean(right) >= 0.9
    found = ml.pca_per_class(df, 2).collect()
    assert len(found) == 240 and np.mean([r["label"] == r["class"] for r in found]) >= 0.85
    w = ml.rank_model(spark.createDataFrame([(1, [1.0, 0.1 * i]) for i in range(9)] + [(-1, [-1.0, 0.1 * i]) for i in range(9)], "target int, q array<double>"))
    assert w[0] > 0.2 > abs(w[1])


def test_shuffles_repeat_and_differ_by_seed(spark):
    df = blobs(spark)
    order = lambda seed: [tuple(r) for r in ml.shuffle_samples(df.select("id", "label"), seed).orderBy("label", "place").collect()]
    assert order(1) == order(1) != order(2)
    assert sorted(r[2] for r in order(1) if r[1] == 3) == list(range(1, 61))


def test_kernels_of_sparse_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [([float(x) if rng.random() < 0.4 else 0.0 for x in rng.integers(-5, 6, 12)], [float(x) if rng.random() < 0.4 else 0.0 for x in rng.integers(-5, 6, 12)]) for _ in range(60)]
    rows += [([0.0] * 12, [1.0] * 12), ([], []), ([2.0], [3.0])]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>")
    own = [k(F.col("a"), F.col("b")) for k in (kernels.dot, kernels.rbf(0.1), kernels.polynomial(3, 0.5, 2.0), kernels.sigmoid(0.1, 0.2))]
    a, b = kernels.sparse(F.col("a")), kernels.sparse(F.col("b"))
    of = kernels.sparse_dot
    same = [k(a, b) for k in (of, kernels.rbf(0.1, of), kernels.polynomial(3, 0.5, 2.0, of), kernels.sigmoid(0.1, 0.2, of))]
    for r in df.select("a", "b", F.array(*own).alias("x"), F.array(*same).alias("y")).collect():
        d = float(np.dot(r["a"], r["b"]))
        apart = float(np.sum((np.array(r["a"]) - r["b"]) ** 2))
        want = [d, np.exp(-0.1 * apart), (0.5 * d + 2) ** 3, np.tanh(0.1 * d + 0.2)]
        np.testing.assert_allclose(r["x"], want, atol=1e-12)
        np.testing.assert_allclose(r["y"], want, atol=1e-12)


def test_models_beyond_a_broadcast_are_refused(spark, monkeypatch):
    df = blobs(spark)
    monkeypatch.setattr(ml, "MODEL_BYTES", 64)
    with pytest.raises(ValueError, match="bytes"):
        ml.score(df, spark.createDataFrame([(0, [1.0] * 9, 0.0)], "class long, w array<double>, b double"))
