"""Scored fact table, risk bands, worklist and the small tables of the trust page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.functions import as_column, cut, round_stable
from sparkrisk.operators.models import PROBABILITY, predict
from sparkrisk.operators.rank import ranked_top_k, tile_cuts, tile_of
from sparkrisk.operators.split import out_of_sample
from sparkrisk.spec import ENCOUNTERS, RISK_BANDS, WORKLIST_COLUMNS, EncounterSpec

RISK, DECILE, BAND = "predicted_risk_probability", "predicted_risk_decile", "risk_band"


def with_deciles_and_bands(df: DataFrame, id: str, score: str = RISK) -> DataFrame:
    """Decile and band on out-of-sample rows, null on training rows."""
    test = F.col("data_split") == "test"
    cuts = tile_cuts(df.filter(test), score, id, 10, "qcut")
    return df.withColumn(DECILE, F.when(test, tile_of(score, id, cuts))).withColumn(
        BAND, cut(DECILE, RISK_BANDS))


def score_fact(df: DataFrame, model: PipelineModel, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """Every column of ``df`` (which must carry its split) plus the probability.

    The classifier sees the numbered copies of the features only; all original columns
    travel along, so nothing is joined back.
    """
    scored = predict(model, df, spec, keep=df.columns)
    return scored.select(*[as_column(c) for c in df.columns],
                         F.round(PROBABILITY, 4).alias(RISK))


def worklist(fact: DataFrame, k: int = 200, columns: Sequence[str] = WORKLIST_COLUMNS,
             score: str = RISK, id: str = "encounter_id") -> DataFrame:
    """The ``k`` out-of-sample rows with the highest score, ranked; smaller id on ties."""
    rows = out_of_sample(fact).select(*[as_column(c) for c in columns])
    return ranked_top_k(rows, [F.desc(score), F.asc(id)], k)


def model_performance_table(comparison: DataFrame, summary: DataFrame) -> DataFrame:
    """Comparison table plus the lift looked up in the summary document by model name."""
    entry = summary.select(F.inline("model_comparison")).select(
        "model", F.col("lift_vs_random").alias("top_decile_lift"))
    return comparison.join(F.broadcast(entry), "model", "left")


def fairness_table(summary: DataFrame) -> DataFrame:
    """AUC without and with the fairness columns, from the summary document."""
    check = F.col("fairness_check")
    return summary.select(F.inline(F.array(
        F.struct(F.lit("race + payer_code excluded (production default)").alias("check"),
                 check["auc_without_race_payer"].alias("roc_auc")),
        F.struct(F.lit("race + payer_code included").alias("check"),
                 check["auc_with_race_payer"].alias("roc_auc")))))


def band_validation(fact: DataFrame, label: str) -> DataFrame:
    """Rows and label rate per band on out-of-sample rows."""
    return out_of_sample(fact).groupBy(BAND).agg(
        F.count(F.lit(1)).alias("count"),
        round_stable(F.avg(as_column(label))).alias("mean")).orderBy(BAND)
