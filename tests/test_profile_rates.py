"""Profiles against pandas; rate tables, order and edge cases."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkrisk.operators import profile, rates


@pytest.fixture(scope="module")
def table(spark):
    rnd = random.Random(9)
    pdf = pd.DataFrame({
        "ints": [float(rnd.randrange(4)) for _ in range(700)],
        "reals": [rnd.gauss(0, 10) for _ in range(700)],
        "flat": [3.0] * 700,
        "gaps": [None if rnd.random() < 0.3 else rnd.random() for _ in range(700)],
        "empty": [None] * 700,
    }).astype(float)
    rows = [tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)]
    return pdf, spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf))


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_quantiles_are_exact_at_any_accuracy(table, accuracy):
    pdf, df = table
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["feature"]: r for r in profile.exact_quantiles(
        df, list(pdf.columns), probs, accuracy).collect()}
    assert "empty" not in got
    for c in ("ints", "reals", "flat", "gaps"):
        want = pdf[c].quantile(probs).to_numpy()
        assert np.allclose([got[c][f"q{j}"] for j in range(len(probs))], want, atol=1e-12)


@pytest.mark.parametrize("accuracy, most", [(400, 50), (60, 20), (8, 1)])
def test_wide_brackets_are_narrowed(spark, accuracy, most):
    """Brackets with too many rows are sketched again, also by poor sketches; ties are kept."""
    rnd = random.Random(accuracy)
    values = [rnd.gauss(0, 1) for _ in range(6000)] + [0.25] * 3000 + [None] * 50
    df = spark.createDataFrame([(v, 1.0) for v in values], "v double, one double").repartition(20)
    probs = [0.0, 0.01, 0.3, 0.5, 0.501, 0.9, 1.0]
    got = {r["feature"]: r for r in profile.exact_quantiles(
        df, ["v", "one"], probs, accuracy, most).collect()}
    want = np.quantile([v for v in values if v is not None], probs)
    assert np.allclose([got["v"][f"q{j}"] for j in range(len(probs))], want, atol=1e-12)
    assert {got["one"][f"q{j}"] for j in range(len(probs))} == {1.0}


def test_describe_matches_pandas(table):
    pdf, df = table
    want = pdf.describe().T
    for r in profile.describe_numeric(df, list(pdf.columns)).collect():
        w = want.loc[r["feature"]]
        assert r["count"] == w["count"]
        if r["count"]:
            for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"),
                                 ("p50", "50%"), ("p75", "75%"), ("max", "max")):
                assert r[ours] == pytest.approx(w[theirs], abs=1e-6)


def test_outliers_are_strict(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 7, 7.0001, -2, -50]], "v double")
    row = profile.iqr_outliers(df, ["v"]).first()
    pdf = df.toPandas()["v"]
    q1, q3 = pdf.quantile([0.25, 0.75])
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    assert row["n_outliers"] == ((pdf < low) | (pdf > high)).sum()
    box = profile.box_stats(df, ["v"]).first()
    inside = pdf[(pdf >= low) & (pdf <= high)]
    assert (box["whisker_low"], box["whisker_high"]) == (inside.min(), inside.max())


def test_histogram_counts_every_value(table):
    pdf, df = table
    got = profile.histogram(df, list(pdf.columns), 30).toPandas()
    for c in ("ints", "reals", "gaps"):
        want, _ = np.histogram(pdf[c].dropna(), bins=30)
        ours = got[got.feature == c].set_index("bin")["n"].reindex(range(30), fill_value=0)
        assert ours.sum() == pdf[c].count() and abs(ours.to_numpy() - want).sum() <= 2
    assert got[got.feature == "flat"]["n"].tolist() == [700]
    assert not (got.feature == "empty").any()


def test_correlation_ignores_null_pairs(table):
    pdf, df = table
    got = {(r["feature_a"], r["feature_b"]): r["r"]
           for r in profile.corr_matrix(df, ["ints", "reals", "gaps"]).collect()}
    for (a, b), r in got.items():
        assert r == pytest.approx(pdf[a].corr(pdf[b]), abs=1e-6)
    ordered = [r["r"] for r in profile.corr_with(df, ["ints", "gaps"], "reals").collect()]
    assert ordered == sorted(ordered, reverse=True)


def test_null_report_and_cardinality(table):
    pdf, df = table
    report = [tuple(r) for r in profile.null_report(df).collect()]
    assert report[0] == ("empty", 700, 100.0) and report[1][0] == "gaps" and len(report) == 2
    assert profile.total_nulls(df).first()[0] == pdf.isna().sum().sum()
    exact = {r["feature"]: r["n_distinct"] for r in profile.cardinality(df, list(pdf)).collect()}
    assert exact == {c: pdf[c].nunique() for c in pdf}
    rough = {r["feature"]: r["n_distinct"] for r in profile.cardinality(
        df, ["ints", "empty"], approx=True).collect()}
    assert rough == {"ints": 4, "empty": 0}


def test_near_zero_variance(spark):
    df = spark.createDataFrame([("No" if i else "Up", "No" if i % 9 else "Up") for i in range(1000)],
                               "rare string, common string")
    assert [r["feature"] for r in profile.near_zero_variance(df, ["rare", "common"]).collect()] == [
        "rare"]


@pytest.fixture(scope="module")
def visits(spark):
    rows = ([(9, "a", 1)] * 3 + [(15, "a", 0)] * 5 + [(16, "b", 1)] * 4 + [(None, None, 0)] * 2)
    return spark.createDataFrame(rows, "source_id int, grp string, y int")


def test_rates_order_threshold_and_null_group(visits):
    kept = rates.rate_by(visits, "grp", "y").collect()
    assert [r["grp"] for r in kept] == ["b", "a", None]
    assert [r["readmit_rate_pct"] for r in kept] == [100.0, 37.5, 0.0]
    dropped = rates.rate_by(visits, "grp", "y", drop_null=True, share=True).collect()
    assert [r["pct_of_all_encounters"] for r in dropped] == [28.57, 57.14]
    assert [r["grp"] for r in rates.rate_by(visits, "grp", "y", min_n=5).collect()] == ["a"]


def test_dimension_join_kinds_and_blank_sensitive_labels(spark, visits):
    dim = spark.createDataFrame([(9, " Not Available"), (15, "Not Available"), (17, "Not Available")],
                                "source_id int, description string")
    inner = {r["s"]: r["n_encounters"] for r in rates.rate_by_dim(
        visits, dim, "source_id", "y", "s").collect()}
    assert inner == {" Not Available": 3, "Not Available": 5}
    left = {r["s"]: r["n_encounters"] for r in rates.rate_by_dim(
        visits, dim, "source_id", "y", "s", how="left").collect()}
    assert left == {" Not Available": 3, "Not Available": 5, None: 6}


def test_tiers_come_in_order_of_their_values(spark):
    df = spark.createDataFrame([(v, 0) for v in [7, 4, 0, 1]], "u int, y int")
    tiers = [(0, 0, "z none"), (1, 2, "y low"), (3, 5, "x mid")]
    got = rates.rate_by_tier(df, "u", tiers, "a high", "y", "tier").collect()
    assert [r["tier"] for r in got] == ["z none", "y low", "x mid", "a high"]


def test_empty_table_gives_null_rates(spark):
    df = spark.createDataFrame([], "g string, y int, los int")
    assert tuple(rates.overall_rate(df, "y").first()) == (0, 0, None)
    assert tuple(rates.kpis(df, "y", "los").first()) == (0, 0, 0.0, 0.0)
    assert rates.rate_by(df, "g", "y", share=True).count() == 0
    assert tuple(rates.leakage_check(df, "g", ["x"], "y").first()) == (0, None, None)


def test_matrix_and_counts(spark, visits):
    top = rates.segment_matrix(visits, {"grp": "grp", "s": F.col("source_id")}, "y", min_n=2, k=2)
    assert [tuple(r)[:3] for r in top.collect()] == [("a", 9, 3), ("b", 16, 4)]
    counts = [tuple(r) for r in rates.value_counts(visits, "grp").collect()]
    assert counts == [("a", 8, 66.67), ("b", 4, 33.33)]
    assert tuple(rates.class_balance(visits, "y").first()) == (7, 7, 1.0)
