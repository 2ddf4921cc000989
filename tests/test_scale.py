"""Sums, ties and partitions of tables larger than those of the other tests."""

from roadlens.operators import aggregates, plates, windows
from roadlens.plans import ranking

from .conftest import DATA


def test_otsu_of_counts_whose_products_outgrow_a_long(spark):
    rows = [("small", 1, 5), ("small", 2, 1), ("small", 9, 6), ("large", 1, 5 * 10**9), ("large", 2, 10**9), ("large", 9, 6 * 10**9)]
    df = spark.createDataFrame(rows, "key string, bin long, cnt long")
    assert {r["key"]: r["threshold"] for r in aggregates.otsu(df, "bin", ["key"]).collect()} == {"small": 2, "large": 2}


def test_an_outlier_at_three_deviations_is_no_outlier(spark):
    # mean 100 and deviation 11: what is 33 off is at the limit, what is 34 off beyond it
    rows = [(k, n, 100 * n, 100 * 100 * n + 11 * 11 * n, x) for k, (n, x) in enumerate([(3, 133), (3, 134), (7, 67), (7, 66), (9, 170), (9, 171), (49, 133)])]
    df = spark.createDataFrame(rows, "k long, n long, s long, q long, x long")
    flags = {r["k"]: r["flag"] for r in aggregates.outliers(df, "x").collect()}
    assert flags == {0: "ok", 1: "soft", 2: "ok", 3: "soft", 4: "soft", 5: "hard", 6: "ok"}


def test_plates_are_spread_over_more_partitions_as_they_grow(spark, monkeypatch):
    few = ranking.t5(spark, DATA)
    monkeypatch.setattr(windows, "SPREAD_ROWS", 200)
    many = ranking.t5(spark, DATA)
    assert many.rdd.getNumPartitions() >= 25 > few.rdd.getNumPartitions()
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    votes = spark.createDataFrame([(p, 0, "A", p) for p in range(1000)], "plate_id long, pos long, letter string, total long")
    assert plates.prune_letters(votes, 5).rdd.getNumPartitions() == 5


def test_texts_are_ranked_without_sorting_those_of_many_plates(spark):
    """Each of these sorts the letters as often as t6 does, and nothing after the texts are made."""
    sorts = lambda q: q(spark, DATA)._jdf.queryExecution().executedPlan().toString().count("Sort [")
    assert {sorts(q) for q in (ranking.t4, ranking.t8, ranking.t9, ranking.k5)} == {sorts(ranking.t6)}
    assert sorts(ranking.t6) <= 4  # one more each for a second rank, and for each place's best and last
