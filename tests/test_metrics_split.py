"""Metrics against brute force and spark.ml; splits by whole groups."""

import random

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from sparkrisk.operators import metrics
from sparkrisk.operators import split as splits


def scored(spark, n=400, levels=None, seed=5):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        s = rnd.random() if levels is None else rnd.randrange(levels) / levels
        rows.append((i, s, int(rnd.random() < 0.2 + 0.5 * s)))
    return rows, spark.createDataFrame(rows, "id long, s double, y int")


def brute_auc(rows):
    pos, neg = [r[1] for r in rows if r[2]], [r[1] for r in rows if not r[2]]
    wins = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("levels", [None, 2, 7])
def test_auc_is_exact_with_ties(spark, levels):
    rows, df = scored(spark, levels=levels)
    got = metrics.roc_auc(df, "s", "y", buckets=16).first()[0]
    assert got == pytest.approx(brute_auc(rows), abs=1e-6)
    flipped = metrics.roc_auc(df.withColumn("s", -F.col("s")), "s", "y").first()[0]
    assert got + flipped == pytest.approx(1.0, abs=2e-6)
    ml = BinaryClassificationEvaluator(
        rawPredictionCol="raw", labelCol="y", numBins=0).evaluate(
        df.withColumn("raw", array_to_vector(F.array(-F.col("s"), F.col("s")))))
    assert got == pytest.approx(ml, abs=1e-6)


def test_auc_needs_both_classes(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (2, 0.7, 1)], "id long, s double, y int")
    assert metrics.roc_auc(df, "s", "y").first()[0] is None


def test_roc_curve_ends_at_one_and_rises(spark):
    _, df = scored(spark)
    points = metrics.roc_curve(df, "s", "y", 20).collect()
    assert len(points) == 21 and (points[-1]["fpr"], points[-1]["tpr"]) == (1.0, 1.0)
    assert tuple(points[0]) == (0, None, 0.0, 0.0)
    every = metrics.roc_curve(df, "s", "y").collect()
    assert len(every) == 1 + df.select("s").dropna().distinct().count()
    assert [p["tpr"] for p in points] == sorted(p["tpr"] for p in points)
    cuts = [p["threshold"] for p in points[1:]]
    assert cuts == sorted(cuts, reverse=True)


def test_metrics_zero_where_undefined(spark):
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert (row["precision"], row["recall"], row["f1"], row["accuracy"]) == (0.0, 0.0, 0.0, 0.5)
    df = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (0, 1), (0, 0)], "y int, p int")
    row = metrics.binary_metrics(df, "y", "p").first()
    assert (row["tp"], row["fp"], row["tn"], row["fn"]) == (2, 1, 1, 1)
    assert row["f1"] == pytest.approx(2 / 3, abs=1e-6)


def test_same_scores(spark):
    _, df = scored(spark, 30)
    metrics.assert_same_scores(df, df, "id", "s")
    with pytest.raises(ValueError):
        metrics.assert_same_scores(df, df.filter("id > 0"), "id", "s")
    with pytest.raises(ValueError):
        metrics.assert_same_scores(df, df.withColumn("s", F.col("s") + 1e-3), "id", "s")


@pytest.mark.parametrize("exact", [False, True])
def test_groups_stay_whole(spark, exact):
    rnd = random.Random(1)
    df = spark.createDataFrame([(i, 0 if rnd.random() < 0.34 else rnd.randrange(1, 213))
                                for i in range(3000)], "id long, g long")
    out = splits.group_split(df, "g", 0.2, exact=exact)
    assert splits.split_overlap(out, "g").first()["n_in_both"] == 0
    test, train = out.filter("data_split = 'test'"), out.filter("data_split = 'train'")
    splits.assert_disjoint(test, train, "g")
    n_groups = df.select("g").distinct().count()
    n_test = test.select("g").distinct().count()
    if exact:
        assert n_test == -(-n_groups // 5)
    else:
        assert 0.1 < n_test / n_groups < 0.3
    assert test.count() == out.filter("is_out_of_sample_prediction").count()


def test_disjoint_raises(spark):
    a = spark.createDataFrame([(1,), (2,)], "g long")
    with pytest.raises(ValueError):
        splits.assert_disjoint(a, a.filter("g = 2"), "g")


def test_hash_split_is_stable_when_rows_are_added(spark):
    small = spark.range(100).withColumnRenamed("id", "g")
    big = spark.range(500).withColumnRenamed("id", "g")
    side = {r["g"]: r["data_split"] for r in splits.group_split(big, "g").collect()}
    assert all(side[r["g"]] == r["data_split"] for r in splits.group_split(small, "g").collect())


def test_exact_split_of_nothing(spark):
    df = spark.createDataFrame([], "g long")
    assert splits.group_split(df, "g", exact=True).count() == 0
