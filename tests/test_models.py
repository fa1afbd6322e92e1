"""Encoding, weighting, fitting, attribution and the whole modelling run on small data."""

import itertools
import math
import random
import threading

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sparkrisk import spec as S
from sparkrisk.operators import explain, metrics, models, profile, rank, serve, trees
from sparkrisk.operators import split as splits
from sparkrisk.plans import pipeline
from sparkrisk.plans.cleaning import clean, cleaning_audit, top_lists
from sparkrisk.plans.export import export_dashboard
from sparkrisk.plans.pipeline import run_models
from sparkrisk.sources import readers, sinks
from sparkrisk.sources.lookups import lookups
from sparkrisk.sources.star import encounters_raw
from sparkrisk.streaming.scoring import score_new, start_scoring
from sparkrisk.workspace import fresh

SMALL = S.EncounterSpec(
    numeric=("number_inpatient", "number_diagnoses", "age_numeric"),
    categorical=("gender", "diag_1_group"), fairness=("race",))


@pytest.fixture(scope="module")
def raw(spark):
    return fresh(spark, "raw", encounters_raw(spark, "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def table(spark, raw):
    """Clean rows with a label the features can explain."""
    signal = F.col("number_inpatient") * 3 + F.col("number_diagnoses") + (
        F.col("encounter_id") * 17) % 7
    rows = clean(raw).withColumn("readmitted_30d", (signal >= 12).cast("int"))
    return fresh(spark, "signal", splits.group_split(rows, "patient_nbr"))


def test_clean_schema_and_no_nulls(raw):
    df = clean(raw)
    assert [(f.name, f.dataType) for f in df.schema] == [
        (f.name, f.dataType) for f in S.CLEAN_SCHEMA]
    assert df.dropna().count() == df.count()


def test_frozen_lists_give_the_same_table(raw):
    lists = top_lists(raw)
    assert {c: len(v) for c, v in lists.items()} == {"medical_specialty": 10, "payer_code": 5}
    assert clean(raw, frozen_top=lists).exceptAll(clean(raw)).count() == 0


def test_audit_adds_up(raw):
    steps = cleaning_audit(raw).collect()
    assert steps[0]["rows_in"] == raw.count() and steps[-1]["rows_left"] == clean(raw).count()
    for a, b in zip(steps, steps[1:]):
        assert a["rows_left"] == b["rows_in"] == a["rows_in"] - a["rows_removed"]


def test_unknown_and_null_categories_encode_to_zero(spark):
    train = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "n double, g string")
    new = spark.createDataFrame([(1.0, "b"), (1.0, "zzz"), (1.0, None)], "n double, g string")
    rows = models.model_input(train, ["n"], ["g"], [])
    fitted = PipelineModel(models.fit_encoder(rows, ["n"], ["g"]).stages(False))
    assert models.feature_names(fitted, ["n"], ["g"]) == ["n", "g_a", "g_b", "g_c"]
    got = fitted.transform(models.model_input(new, ["n"], ["g"], [])).select(
        vector_to_array("features")).collect()
    assert [r[0] for r in got] == [[1, 0, 1, 0], [1, 0, 0, 0], [1, 0, 0, 0]]


def test_class_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "y int")
    assert models.class_weights(df, "y", "balanced") == {0: 4 / 6, 1: 2.0}
    assert models.class_weights(df, "y", "positive") == {0: 1.0, 1: 3.0}
    with pytest.raises(ValueError):
        models.class_weights(df.filter("y = 0"), "y", "balanced")


def test_default_settings():
    configs = models.model_configs(1000)
    forest, boosted = configs["Random Forest"].estimator, configs["Gradient-Boosted Trees"].estimator
    assert (forest.getNumTrees(), forest.getMaxDepth(), forest.getMinInstancesPerNode()) == (
        300, 12, 20)
    assert (boosted.getMaxIter(), boosted.getMaxDepth(), boosted.getStepSize()) == (300, 5, 0.05)
    assert configs["Logistic Regression"].estimator.getRegParam() == 0.001


def sides(table):
    return table.filter("data_split = 'train'"), table.filter("data_split = 'test'")


@pytest.mark.parametrize("name", ["Logistic Regression", "Decision Tree", "Random Forest",
                                  "Gradient-Boosted Trees"])
def test_model_learns_reloads_and_explains(spark, table, tmp_path, name):
    train, test = sides(table)
    config = models.model_configs(train.count(), trees=5, rounds=4, max_iter=50)[name]
    model = models.fit_model(train, config, SMALL)
    scored = models.predict(model, test, SMALL)
    assert metrics.roc_auc(scored, models.PROBABILITY, SMALL.label).first()[0] > 0.8

    path = str(tmp_path / "model")
    sinks.save_model(model, path)
    again = models.predict(readers.load_model(path), test, SMALL)
    metrics.assert_same_scores(scored, again, SMALL.id, models.PROBABILITY, 1e-12)

    shap = explain.shap_values(model, test, path, SMALL, background=train)
    names = models.feature_names(model, *SMALL.features())
    rows = shap.join(scored, SMALL.id).collect()
    assert len(rows) == test.count()
    for r in rows:
        assert len(r["shap"]) == len(names)
        assert r["base"] + sum(r["shap"]) == pytest.approx(r["margin"], abs=1e-6)
        p = r["margin"]
        if name in ("Logistic Regression", "Gradient-Boosted Trees"):
            p = 1 / (1 + math.exp(-p))
        assert p == pytest.approx(r[models.PROBABILITY], abs=1e-6)

    long = explain.long_attribution(shap, names, SMALL.id)
    ranked = explain.global_importance(long).collect()
    assert ranked[0]["feature"] in ("number_inpatient", "number_diagnoses")
    local = explain.local_explanation(long, rows[0][SMALL.id], SMALL.id, 3).collect()
    assert [abs(r["shap"]) for r in local] == sorted((abs(r["shap"]) for r in local), reverse=True)
    importance = dict(models.feature_importance(model, SMALL))
    assert set(importance) == set(names) and max(importance.values()) > 0


def brute_shapley(leaves, row, n):
    """Shapley values by enumerating every coalition."""
    def game(coalition):
        total = 0.0
        for value, feats, low, high, share in leaves:
            for f, a, b, s in zip(feats, low, high, share):
                value *= float(a < row[f] <= b) if f in coalition else s
            total += value
        return total

    phi = np.zeros(n)
    for f in range(n):
        others = [g for g in range(n) if g != f]
        for size in range(n):
            weight = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
            for s in itertools.combinations(others, size):
                phi[f] += weight * (game({*s, f}) - game(set(s)))
    return phi


def test_path_attribution_equals_brute_force():
    rnd = random.Random(4)

    def grow(path, depth):
        if depth == 0 or rnd.random() < 0.15:
            feats = sorted(path)
            return [(rnd.uniform(-2, 2), feats, *[[path[f][i] for f in feats] for i in range(3)])]
        f, t, p = rnd.randrange(4), rnd.random(), rnd.uniform(0.1, 0.9)
        low, high, share = path.get(f, (-math.inf, math.inf, 1.0))
        return grow({**path, f: (low, min(high, t), share * p)}, depth - 1) + grow(
            {**path, f: (max(low, t), high, share * (1 - p))}, depth - 1)

    leaves = grow({}, 5) + grow({}, 3)
    x = np.random.default_rng(1).random((6, 4))
    _, phi = explain.path_shapley(x, leaves)
    for row, got in zip(x, phi):
        assert np.allclose(got, brute_shapley(leaves, row, 4), atol=1e-10)


@pytest.mark.parametrize("bits", [1, 3, 14])
def test_equal_results_of_tests_are_attributed_once(monkeypatch, bits):
    """Rows that satisfy the same tests are one pattern, whatever the number of tests together."""
    inf = math.inf
    leaves = [(0.3, [], [], [], []),
              (2.0, [0, 1], [-inf, -inf], [0.5, 0.2], [0.4, 0.7]),
              (-1.0, [0, 1], [-inf, 0.2], [0.5, inf], [0.4, 0.3]),
              (0.5, [0, 2, 3], [0.5, 0.1, -inf], [inf, 0.6, 0.9], [0.6, 0.5, 0.2])]
    x = np.random.default_rng(2).random((500, 5))
    worked_out, step = [], explain._step
    monkeypatch.setattr(explain, "GROUP_BITS", bits)
    monkeypatch.setattr(explain, "_step", lambda hit, *rest: (
        worked_out.append(len(hit)), step(hit, *rest))[1])
    base, phi = explain.path_shapley(x, leaves)
    assert base == pytest.approx(0.3 + 0.56 - 0.12 + 0.03) and phi.shape == x.shape
    assert max(worked_out) <= 32
    for row, got in zip(x[:20], phi):
        assert np.allclose(got, brute_shapley(leaves, row, 5), atol=1e-12)


def test_reliable_features(spark, table):
    often = {r[0] for r in explain.reliable_features(
        table, ["age_numeric"], ["gender", "diag_1_group"], 150).collect()}
    counts = {r["name"]: r["n"] for r in profile.category_counts(
        table, ["gender", "diag_1_group"]).collect()}
    assert often == {"age_numeric"} | {n for n, c in counts.items() if c >= 150}
    assert 0 < len(often) - 1 < len(counts)


def test_whole_run_and_stream(spark, raw, table, tmp_path):
    run = run_models(table.drop("data_split", "is_out_of_sample_prediction"), SMALL,
                     trees=4, rounds=3, max_iter=30)
    assert run.comparison.count() == 4 and run.best in run.fitted
    summary = run.summary.first()
    assert summary["best_model"] == run.best and len(summary["model_comparison"]) == 4
    assert summary["fairness_check"]["auc_without_race_payer"] == max(
        r["roc_auc"] for r in summary["model_comparison"])

    fact = run.fact
    assert fact.columns[-5:] == ["data_split", "is_out_of_sample_prediction", serve.RISK,
                                 serve.DECILE, serve.BAND]
    assert fact.count() == table.count()
    assert fact.filter(F.col("data_split") == "train").filter(
        F.col(serve.DECILE).isNotNull() | F.col(serve.BAND).isNotNull()).count() == 0
    bands = {r[serve.BAND]: r for r in serve.band_validation(fact, SMALL.label).collect()}
    high, low = bands["High Risk (Top 20%)"], bands["Low Risk (Bottom 50%)"]
    assert high["mean"] > low["mean"] and high["count"] < low["count"]
    work = serve.worklist(fact, 25).collect()
    assert [r["priority_rank"] for r in work] == list(range(1, 26))
    assert work[0][serve.RISK] == max(r[serve.RISK] for r in work)

    export_dashboard(run, lookups(spark), str(tmp_path / "board"), k=25)
    exported = spark.read.parquet(str(tmp_path / "board" / "fact_encounters"))
    assert set(exported.columns) == set(fact.columns) and exported.count() == fact.count()
    sheet = spark.read.csv(str(tmp_path / "board" / "high_risk_worklist"), header=True)
    assert sheet.columns == ["priority_rank", *S.WORKLIST_COLUMNS] and sheet.count() == 25
    assert readers.read_summary(spark, str(tmp_path / "board" / "model_summary")).first() == summary
    assert spark.read.csv(str(tmp_path / "board" / "dim_admission_source"), header=True).count() == 25

    # the same rows through a stream get the same scores
    cuts = rank.tile_cuts(splits.out_of_sample(fact), serve.RISK, SMALL.id, 10, "qcut")
    lists = top_lists(raw)
    raw.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(S.RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    query = start_scoring(stream, run.model, lists, cuts, str(tmp_path / "out"),
                          str(tmp_path / "checkpoint"), k=10, spec=SMALL)
    query.awaitTermination()
    written = spark.read.parquet(str(tmp_path / "out" / "scored"))
    batch = score_new(raw, run.model, lists, cuts, SMALL)
    metrics.assert_same_scores(written, batch, SMALL.id, serve.RISK)
    assert spark.read.parquet(str(tmp_path / "out" / "worklist")).count() == 30


def test_fits_run_at_once_over_as_many_partitions_as_rows_fill(spark, table, monkeypatch):
    """Each fit waits for the other; eight files of a few rows are one partition."""
    meet, seen = threading.Barrier(2, timeout=60), []
    fit = models.fit_encoded

    def waiting(encoder, encoded, config, spec):
        meet.wait()
        seen.append(encoded.rdd.getNumPartitions())
        return fit(encoder, encoded, config, spec)

    monkeypatch.setattr(models, "fit_encoded", waiting)
    train, test = sides(table)
    train = train.limit(2000).repartition(8)
    configs = models.model_configs(2000, max_iter=5)
    some = {name: configs[name] for name in ("Decision Tree", "Logistic Regression")}
    fitted, comparison = pipeline.compare_models(train, test, some, SMALL)
    assert list(fitted) == list(some) and comparison.count() == 2 and seen == [1, 1]


@pytest.mark.parametrize("name", ["Decision Tree", "Random Forest", "Gradient-Boosted Trees"])
def test_trees_walked_over_blocks_score_as_transform_does(spark, table, name):
    """Block after block, and categories that training rows did not have."""
    train, test = sides(table)
    config = models.model_configs(train.count(), trees=7, rounds=4)[name]
    model = models.fit_model(train, config, SMALL)
    test = test.withColumn("gender", F.when(F.col("encounter_id") % 5 == 0, "new").otherwise(
        F.col("gender")))
    ready = models.model_input(test, *SMALL.features(), [SMALL.id])
    want = {r[SMALL.id]: r for r in model.transform(ready).collect()}
    found = trees.ensemble(model.stages[-1], spark)
    x = np.array([r["features"].toArray() for r in want.values()])
    x = np.tile(x, (-(-2 * trees.ROWS_PER_STEP // len(x)), 1))
    label, chance = found.score(x)
    for at, r in enumerate(want.values()):
        for k in range(at, len(x), len(want)):
            assert label[k] == r["prediction"]
            assert chance[k] == pytest.approx(r["probability"][1], abs=1e-14)
    plan = models.predict(model, test, SMALL)
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()
    got = {r[SMALL.id]: r for r in plan.collect()}
    assert {k: r[models.PREDICTION] for k, r in got.items()} == {
        k: r["prediction"] for k, r in want.items()}


def test_tree_scores_read_numbers_and_indices_not_vectors(spark, table):
    """The 1-of-n slots of a row follow from its index; the vector is not assembled."""
    train, test = sides(table)
    model = models.fit_model(train, models.model_configs(train.count(), trees=7)["Random Forest"],
                             SMALL)
    column, codes = trees.coded(model.stages[:-1], "features")
    test = test.withColumn("gender", F.when(F.col("encounter_id") % 5 == 0, "new").otherwise(
        F.col("gender")))
    rows = PipelineModel(model.stages[:-1]).transform(
        models.model_input(test, *SMALL.features(), [SMALL.id]))
    found = rows.select("features", column.alias("few")).collect()
    x = np.array([r["few"] for r in found]).T
    assert len(x) == 5 and codes.numbers == 3
    want = np.array([r["features"].toArray() for r in found]).T
    assert want.shape[0] == 3 + sum(codes.widths)
    for slot, values in enumerate(want):
        assert np.array_equal(codes.slot(x, slot), values)
    plan = models.predict(model, test, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "features" not in plan
    assert trees.coded(model.stages[1:-1], "features") is None


def test_training_sample_is_read_from_a_table_of_its_own(spark, table, monkeypatch):
    """Encoding reads the sample many times, and must not read the whole table each time."""
    seen = []

    def watched(train, *rest, encode=models.encode_training):
        seen.append(sum(f.endswith(".parquet") and "/training-" in f for f in train.inputFiles()))
        seen.append(train.count())
        return encode(train, *rest)

    monkeypatch.setattr(models, "encode_training", watched)
    run_models(table.drop("data_split", "is_out_of_sample_prediction"), SMALL, trees=2, rounds=1,
               max_iter=5, max_train_rows=800)
    assert len(seen) == 4 and seen[0] and seen[2] and seen[1] == seen[3] < 1100


@pytest.mark.parametrize("n", [20, 10_001, 115_664, 7_000_000, 2 ** 31 - 1])
def test_thresholds_are_sought_in_all_rows(spark, n):
    """spark.ml reads as many rows for them as the square of the bins, 10,000 at least."""
    trees_of = [c.estimator for c in models.model_configs(n).values() if not c.scaled]
    assert len(trees_of) == 3
    for estimator in trees_of:
        bins = estimator.getMaxBins()
        assert 32 <= bins <= max(32, n) and min(n, models.MAX_BINS ** 2) <= bins ** 2 < 2 ** 31


def test_threshold_between_two_of_many_values(spark):
    """12,000 rows of 300 values: the one test that tells the classes apart is found."""
    rows = spark.range(12_000).select(
        F.col("id").alias("encounter_id"), (F.col("id") % 300).alias("x"),
        (F.col("id") % 300 > 137).cast("int").alias("readmitted_30d"))
    spec = S.EncounterSpec(numeric=("x",), categorical=(), fairness=())
    model = models.fit_model(rows, models.model_configs(12_000)["Decision Tree"], spec)
    scored = models.predict(model, rows, spec)
    assert scored.filter(F.col(models.PREDICTION) != F.col("readmitted_30d")).count() == 0


def test_forest_of_leaves_and_categories_of_one_slot():
    """A tree that is a leaf, a test on categories, a NaN and a row on the threshold."""
    nodes = pd.DataFrame({
        "tree": [0, 1, 1, 1, 1, 1], "id": [0, 0, 1, 2, 3, 4], "prediction": 0.0,
        "impurityStats": [[1.0, 3.0], [9.0, 9.0], [4.0, 0.0], [5.0, 5.0], [1.0, 1.0], [0.0, 2.0]],
        "leftChild": [-1, 1, -1, 3, -1, -1], "rightChild": [-1, 2, -1, 4, -1, -1],
        "feature": [-1, 0, -1, 1, -1, -1], "categories": [-1, -1, -1, 3, -1, -1],
        "left": [[], [0.5], [], [0.0, 2.0], [], []]})
    found = trees._ensemble(nodes, "votes", [1.0, 1.0])
    label, chance = found.score(np.array([[0.5, 0], [0.6, 2], [0.6, 1], [math.nan, 1]]))
    assert label.tolist() == [0, 1, 1, 1]
    assert chance.tolist() == [0.375, 0.625, 0.875, 0.875]
