"""Split, fit, evaluate, score and explain as one run over a clean table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrisk.operators import models, serve
from sparkrisk.operators.split import group_split, out_of_sample, sample_rows
from sparkrisk.sources.sinks import save_model
from sparkrisk.spec import ENCOUNTERS, EncounterSpec
from sparkrisk.workspace import fresh, run_dir

#: encoded rows that one task of a fit holds at least: fewer take less time than the job around them
ROWS_PER_FIT_TASK = 20_000
#: and at most: beyond as many as there are cores, a task more costs a forest another set of counts
MAX_ROWS_PER_FIT_TASK = 250_000


def fit_tasks(spark: SparkSession, rows: int) -> int:
    """Tasks that a fit over so many rows is dealt to."""
    cores = spark.sparkContext.defaultParallelism
    return max(1, min(-(-rows // ROWS_PER_FIT_TASK),
                      max(cores, -(-rows // MAX_ROWS_PER_FIT_TASK))))


@dataclass(frozen=True)
class ModelRun:
    """Everything the serving and explanation steps need."""

    table: DataFrame                    # clean rows with their split
    fitted: dict[str, PipelineModel]
    comparison: DataFrame
    best: str
    summary: DataFrame
    fact: DataFrame                     # scored, with decile and band
    model_dir: str

    @property
    def model(self) -> PipelineModel:
        return self.fitted[self.best]


def compare_models(train: DataFrame, test: DataFrame, configs: dict[str, models.ModelConfig],
                   spec: EncounterSpec = ENCOUNTERS, include_fairness: bool = False
                   ) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Fit every configuration; one row of test metrics each, all models in the same passes.

    A fit is a long row of short jobs, so all fits run at once, and over as many partitions as
    the training rows fill, not as many as the table they were taken from has.
    """
    spark = train.sparkSession
    encoder, encoded = models.encode_training(train, spec, include_fairness)
    encoded = fresh(spark, "encoded", encoded)
    encoded = encoded.coalesce(fit_tasks(spark, encoded.count()))
    fit = inheritable_thread_target(spark)(
        lambda config: models.fit_encoded(encoder, encoded, config, spec))
    with ThreadPoolExecutor(max(1, len(configs))) as pool:
        fitted = dict(zip(configs, pool.map(fit, configs.values()), strict=True))
    scored = fresh(test.sparkSession, "predictions", models.predict_all(
        fitted, test, spec, include_fairness))
    table = models.evaluate_models(scored, spec)
    return fitted, fresh(test.sparkSession, "comparison", table.coalesce(1))


def fairness_check(train: DataFrame, test: DataFrame, best: str, config: models.ModelConfig,
                   comparison: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """AUC of the best model without and with the fairness columns, and the uplift."""
    _, with_columns = compare_models(train, test, {best: config}, spec, include_fairness=True)
    base = comparison.filter(F.col("model") == best).select(
        F.col("roc_auc").alias("auc_without_race_payer"))
    extra = with_columns.select(F.col("roc_auc").alias("auc_with_race_payer")).first()[0]
    with_auc = F.lit(extra)
    return base.select("auc_without_race_payer", with_auc.alias("auc_with_race_payer"),
                       F.round(with_auc - F.col("auc_without_race_payer"), 4)
                       .alias("auc_uplift"))


def summarise(comparison: DataFrame, best: str, fairness: DataFrame) -> DataFrame:
    """The nested summary document as a one-row table."""
    listed = comparison.agg(F.collect_list(F.struct(*comparison.columns))
                            .alias("model_comparison"))  # one struct per model
    check = fairness.first()
    return listed.select(
        "model_comparison", F.lit(best).alias("best_model"),
        F.struct(*[F.lit(check[c]).alias(c) for c in fairness.columns]).alias("fairness_check"))


def run_models(clean: DataFrame, spec: EncounterSpec = ENCOUNTERS, trees: int = 300,
               rounds: int = 300, max_iter: int = 1000, exact_split: bool = True,
               max_train_rows: int | None = None) -> ModelRun:
    """The whole modelling run. The split is written with the table, never re-derived.

    Classifiers are fitted on all training rows, or if ``max_train_rows`` is given on about that
    many, by the hash of the id; tests, scores and explanations always cover all rows.
    """
    spark = clean.sparkSession
    table = fresh(spark, "modelling", group_split(
        clean, spec.group, spec.test_size, spec.seed, exact=exact_split))
    test = out_of_sample(table)
    train = sample_rows(table.filter(F.col("data_split") == "train"), spec.id, max_train_rows,
                        spec.seed)
    n_train = train.count()
    # encoding reads them a dozen times: they alone, dealt evenly to the tasks of the fits
    train = fresh(spark, "training", train.repartition(fit_tasks(spark, n_train)))
    configs = models.model_configs(n_train, trees, rounds, max_iter, spec.seed)
    fitted, comparison = compare_models(train, test, configs, spec)
    best = models.best_model(comparison, list(configs))
    # the fit caches its rows where tasks are free, so it has the cluster to itself
    check = fairness_check(train, test, best, configs[best], comparison, spec)
    model_dir = f"{run_dir(spark)}/best_model"
    save_model(fitted[best], model_dir)
    scored = fresh(spark, "scored", serve.score_fact(table, fitted[best], spec))
    fact = serve.with_deciles_and_bands(scored, spec.id)
    summary = fresh(spark, "summary", summarise(comparison, best, check))
    return ModelRun(table, fitted, comparison, best, summary, fact, model_dir)
