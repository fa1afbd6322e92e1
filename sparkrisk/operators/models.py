"""Weighted classifiers on spark.ml, evaluated with the exact metrics of this package."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier,
)
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.functions import as_column
from sparkrisk.operators.metrics import evaluate_by
from sparkrisk.operators.trees import ensemble, is_tree_model, tree_scores
from sparkrisk.spec import ENCOUNTERS, EncounterSpec

#: the indexer brings all values of a category to the driver
MAX_CATEGORIES = 100_000
#: the largest number whose square is an integer of 32 bits
MAX_BINS = 46_340
FEATURES, SCALED, WEIGHT = "features", "features_scaled", "class_weight"
PROBABILITY, PREDICTION = "probability_positive", "prediction"


@dataclass(frozen=True)
class ModelConfig:
    estimator: Estimator
    scaled: bool
    weighting: str  # "balanced" or "positive"


def _weights(df: DataFrame, label: str) -> tuple[dict[int, float], dict[int, float]]:
    row = df.agg(F.count_if(as_column(label) == 1).alias("p"),
                 F.count_if(as_column(label) == 0).alias("q")).first()
    pos, neg = row["p"], row["q"]
    if not pos or not neg:
        raise ValueError("both classes must be present to weight them")
    n = pos + neg
    return {0: n / (2 * neg), 1: n / (2 * pos)}, {0: 1.0, 1: neg / pos}


def class_weights(df: DataFrame, label: str, mode: str) -> dict[int, float]:
    """Weight of each class: n / (2 n_c), or neg / pos for positives and 1 for the rest."""
    balanced, positive = _weights(df, label)
    return balanced if mode == "balanced" else positive


def add_class_weight(df: DataFrame, label: str, mode: str = "balanced",
                     out: str = WEIGHT) -> DataFrame:
    weights = class_weights(df, label, mode)
    return df.withColumn(out, F.when(as_column(label) == 1, weights[1]).otherwise(weights[0]))


def lr_config(n_rows: int, max_iter: int = 1000) -> ModelConfig:
    """L2 logistic regression; a penalty of 1 on the summed loss is 1/n on the mean loss."""
    return ModelConfig(LogisticRegression(
        maxIter=max_iter, regParam=1.0 / n_rows, elasticNetParam=0.0, standardization=False),
        True, "balanced")


def max_bins(n_rows: int) -> int:
    """Bins with which a tree model takes its thresholds from all of ``n_rows`` rows.

    ``spark.ml`` looks for thresholds in a sample of as many rows as the square of ``maxBins``
    (10,000 at least). Bins cost nothing where a number has fewer values. The square must be an
    integer of 32 bits, which is enough for 2.1 billion training rows.
    """
    return min(MAX_BINS, max(32, math.isqrt(max(n_rows - 1, 0)) + 1))


def dt_config(seed: int = 42, n_rows: int = 0) -> ModelConfig:
    return ModelConfig(DecisionTreeClassifier(
        maxDepth=8, minInstancesPerNode=50, maxBins=max_bins(n_rows), seed=seed), False, "balanced")


def rf_config(trees: int = 300, depth: int = 12, seed: int = 42, n_rows: int = 0) -> ModelConfig:
    """Rows keep their node of every tree; walking all trees from the root took half the time."""
    return ModelConfig(RandomForestClassifier(
        numTrees=trees, maxDepth=depth, minInstancesPerNode=20, maxBins=max_bins(n_rows),
        featureSubsetStrategy="sqrt", cacheNodeIds=True, seed=seed), False, "balanced")


def gbt_config(rounds: int = 300, depth: int = 5, seed: int = 42, n_rows: int = 0) -> ModelConfig:
    return ModelConfig(GBTClassifier(
        maxIter=rounds, maxDepth=depth, stepSize=0.05, maxBins=max_bins(n_rows), seed=seed),
        False, "positive")


def model_configs(n_rows: int, trees: int = 300, rounds: int = 300, max_iter: int = 1000,
                  seed: int = 42) -> dict[str, ModelConfig]:
    """The four classifiers; smaller ``trees`` and ``rounds`` only for quick runs."""
    return {
        "Logistic Regression": lr_config(n_rows, max_iter),
        "Decision Tree": dt_config(seed, n_rows),
        "Random Forest": rf_config(trees, seed=seed, n_rows=n_rows),
        "Gradient-Boosted Trees": gbt_config(rounds, seed=seed, n_rows=n_rows),
    }


def _plain(name: str) -> str:
    """Stage column names: spark.ml reads neither hyphens nor dots reliably."""
    return name.replace("-", "_").replace(".", "_")


def model_input(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                keep: Sequence[str]) -> DataFrame:
    """Kept columns plus ``num_*`` doubles and ``cat_*`` text under names spark.ml accepts."""
    return df.select(
        *[as_column(c) for c in keep],
        *[as_column(c).cast("double").alias(f"num_{_plain(c)}") for c in numeric],
        *[as_column(c).cast("string").alias(f"cat_{_plain(c)}") for c in categorical])


@dataclass(frozen=True)
class Encoder:
    """Fitted preprocessing: numeric block, then one column per known category.

    ``plain`` leaves numbers as they are (trees), ``scaled`` standardises them (linear
    models); both share the same category columns.
    """

    plain: tuple
    scaled: tuple

    def stages(self, scaled: bool) -> list:
        return list(self.scaled if scaled else self.plain)


def fit_encoder(rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> Encoder:
    """Fit on the output of :func:`model_input` of training rows.

    The indexer keeps unknown and null as an extra index; the one-hot encoder drops the
    last index, which is exactly that one, so every known category has its column and an
    unknown one is all zeros.
    """
    nums = [f"num_{_plain(c)}" for c in numeric]
    cats = [f"cat_{_plain(c)}" for c in categorical]
    block = VectorAssembler(inputCols=nums, outputCol="num_block")
    category_stages: list = []
    if cats:
        seen = rows.agg(*[F.approx_count_distinct(c).alias(c) for c in cats]).first().asDict()
        wide = sorted(c for c, n in seen.items() if n > MAX_CATEGORIES)
        if wide:
            raise ValueError(f"more than {MAX_CATEGORIES} values to encode: {wide}; collapse "
                             "rare ones first")
        category_stages = [
            StringIndexer(inputCols=cats, outputCols=[f"{c}_i" for c in cats],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"{c}_i" for c in cats],
                          outputCols=[f"{c}_v" for c in cats], dropLast=True)]
    fitted = Pipeline(stages=[block, StandardScaler(
        inputCol="num_block", outputCol="num_scaled", withMean=True, withStd=True),
        *category_stages]).fit(rows).stages
    vectors = [f"{c}_v" for c in cats]
    plain = VectorAssembler(inputCols=["num_block", *vectors], outputCol=FEATURES)
    scaled = VectorAssembler(inputCols=["num_scaled", *vectors], outputCol=SCALED)
    return Encoder((fitted[0], *fitted[2:], plain), (*fitted, scaled))


def encode_training(train: DataFrame, spec: EncounterSpec = ENCOUNTERS,
                    include_fairness: bool = False) -> tuple[Encoder, DataFrame]:
    """Encoder and encoded training rows: label, both class weights, both feature vectors.

    Several classifiers read the result many times each, so encode once and stage it.
    """
    numeric, categorical = spec.features(include_fairness)
    rows = model_input(train, numeric, categorical, [spec.label])
    encoder = fit_encoder(rows, numeric, categorical)
    both = PipelineModel([*encoder.plain, encoder.scaled[1], encoder.scaled[-1]]).transform(rows)
    y = as_column(spec.label)
    balanced, positive = _weights(train, spec.label)
    return encoder, both.select(
        y.cast("double").alias(spec.label), FEATURES, SCALED,
        F.when(y == 1, balanced[1]).otherwise(balanced[0]).alias(_weight_column("balanced")),
        F.when(y == 1, positive[1]).otherwise(positive[0]).alias(_weight_column("positive")))


def _weight_column(mode: str) -> str:
    return f"weight_{mode}"


def feature_names(model: PipelineModel, numeric: Sequence[str],
                  categorical: Sequence[str]) -> list[str]:
    """Names of the vector slots: numeric columns, then ``column_value``."""
    names = list(numeric)
    indexers = [s for s in model.stages if hasattr(s, "labelsArray")]
    if indexers:
        for c, labels in zip(categorical, indexers[0].labelsArray):
            names += [f"{c}_{v}" for v in labels]
    return names


def fit_encoded(encoder: Encoder, encoded: DataFrame, config: ModelConfig,
                spec: EncounterSpec = ENCOUNTERS) -> PipelineModel:
    """Fit a classifier on encoded rows; the result starts from unencoded ones."""
    estimator = config.estimator.copy().setParams(
        featuresCol=SCALED if config.scaled else FEATURES, labelCol=spec.label,
        weightCol=_weight_column(config.weighting))
    return PipelineModel([*encoder.stages(config.scaled), estimator.fit(encoded)])


def fit_model(train: DataFrame, config: ModelConfig, spec: EncounterSpec = ENCOUNTERS,
              include_fairness: bool = False) -> PipelineModel:
    """Fit preprocessing and classifier on training rows only."""
    return fit_encoded(*encode_training(train, spec, include_fairness), config, spec)


def predict(model: PipelineModel, df: DataFrame, spec: EncounterSpec = ENCOUNTERS,
            include_fairness: bool = False, keep: Sequence[str] | None = None) -> DataFrame:
    """Kept columns, predicted class and probability of the positive class."""
    numeric, categorical = spec.features(include_fairness)
    keep = list(keep or (spec.id, spec.label))
    rows, last = model_input(df, numeric, categorical, keep), model.stages[-1]
    if is_tree_model(last):
        found = tree_scores([ensemble(last, df.sparkSession)], last.getFeaturesCol(),
                            model.stages[:-1])
        rows = PipelineModel(model.stages[:-1]).transform(rows)
        return rows.withColumn("_found", found).select(
            *[as_column(c) for c in keep], F.col("_found.c0").alias(PREDICTION),
            F.col("_found.p0").alias(PROBABILITY))
    out = model.transform(rows)
    return out.select(
        *[as_column(c) for c in keep], F.col("prediction").cast("int").alias(PREDICTION),
        vector_to_array("probability")[1].alias(PROBABILITY))


def predict_all(fitted: Mapping[str, PipelineModel], df: DataFrame,
                spec: EncounterSpec = ENCOUNTERS, include_fairness: bool = False,
                keep: Sequence[str] | None = None) -> DataFrame:
    """Predictions of several models as a long table (model, ...), in one pass over the rows.

    The models share their encoding, as those of one ``encode_training`` do; every row is
    encoded once.
    """
    numeric, categorical = spec.features(include_fairness)
    keep = list(keep or (spec.id, spec.label))
    rows = model_input(df, numeric, categorical, keep)
    shared: dict[str, object] = {}
    for model in fitted.values():
        shared |= {stage.uid: stage for stage in model.stages[:-1]}
    rows = PipelineModel(list(shared.values())).transform(rows)
    lasts = {name: model.stages[-1] for name, model in fitted.items()}
    trees = [name for name, last in lasts.items() if is_tree_model(last)]
    if trees:
        rows = rows.withColumn("_trees", tree_scores(
            [ensemble(lasts[name], df.sparkSession) for name in trees], FEATURES,
            list(shared.values())))
    found = []
    for i, (name, last) in enumerate(lasts.items()):
        if name in trees:
            k = trees.index(name)
            found.append(F.struct(
                F.lit(name).alias("model"), F.col(f"_trees.c{k}").alias(PREDICTION),
                F.col(f"_trees.p{k}").alias(PROBABILITY)))
            continue
        last = last.copy()
        last.setPredictionCol(f"_class{i}").setProbabilityCol(f"_chance{i}").setRawPredictionCol(
            f"_raw{i}")
        rows = last.transform(rows)
        found.append(F.struct(
            F.lit(name).alias("model"), F.col(f"_class{i}").cast("int").alias(PREDICTION),
            vector_to_array(f"_chance{i}")[1].alias(PROBABILITY)))
    return rows.select(*[as_column(c) for c in keep], F.inline(F.array(*found)))


def evaluate_models(scored: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """One row of metrics per model of a long prediction table."""
    found = evaluate_by(scored, "model", PROBABILITY, spec.label, PREDICTION, spec.id)
    return found.select("model", *[F.round(c, 4).alias(c) for c in (
        "accuracy", "precision", "recall", "f1", "roc_auc")],
        "top_decile_readmit_rate_pct", "pct_of_readmissions_captured",
        F.round("lift_vs_random", 2).alias("lift_vs_random"))


def best_model(metrics: DataFrame, order: Sequence[str] | None = None) -> str:
    """Name of the model with the highest AUC; on ties the first one in ``order``."""
    found = {r["model"]: r["roc_auc"] for r in metrics.select("model", "roc_auc").collect()}
    names = [n for n in order or sorted(found) if n in found]
    return max(names, key=lambda n: float("-inf") if found[n] is None else found[n])


def feature_importance(model: PipelineModel, spec: EncounterSpec = ENCOUNTERS,
                       include_fairness: bool = False) -> list[tuple[str, float]]:
    """(feature, importance) of a tree model, or absolute coefficients of a linear one."""
    names = feature_names(model, *spec.features(include_fairness))
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        values = last.featureImportances.toArray()
    else:
        values = abs(last.coefficients.toArray())
    return [(n, float(v)) for n, v in zip(names, values, strict=True)]


def compare_lift(df: DataFrame, scores: Mapping[str, str], label: str, id: str) -> DataFrame:
    """Top-decile measures of several score columns side by side, in the same passes."""
    long = df.select(as_column(id), as_column(label), F.inline(F.array(*[
        F.struct(F.lit(name).alias("score"), as_column(col).cast("double").alias("_value"),
                 F.lit(0).alias("_class")) for name, col in scores.items()])))
    return evaluate_by(long, "score", "_value", label, "_class", id).select(
        "score", "top_decile_readmit_rate_pct", "pct_of_readmissions_captured", "lift_vs_random")
