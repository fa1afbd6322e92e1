"""Named queries over the test tables, each a function of (session, data folder)."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrisk import spec as S
from sparkrisk.functions import (
    band_lower, band_midpoint, binary_label, clip_upper, flag_ge, flag_gt, icd9_group,
    row_sum, tier, weighted_score,
)
from sparkrisk.operators import explain, filters, metrics, models, profile, rank, rates, serve
from sparkrisk.operators import split as splits
from sparkrisk.plans.cleaning import (
    clean, cleaning_audit, medication_features, normalise, utilization_features, with_label,
)
from sparkrisk.plans.pipeline import ModelRun, run_models
from sparkrisk.sources import catalog, readers, sinks
from sparkrisk.sources.lookups import lookup
from sparkrisk.sources.star import encounter_facts, raw_columns, read_table
from sparkrisk.workspace import run_dir, staged

LABEL, ID, PATIENT = "readmitted_30d", "encounter_id", "patient_nbr"
SPECIALTY_MIN, SOURCE_MIN, SEGMENT_MIN, RELIABLE_MIN = 185, 590, 300, 200
RULE_CUTOFF = 12
PRICE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# ---------------------------------------------------------------- stage tables

def _name(folder: str, table: str) -> str:
    return f"{table}-{hashlib.md5(os.path.abspath(folder).encode()).hexdigest()[:8]}"


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return raw_columns(staged(spark, _name(folder, "encounter_facts"),
                              lambda: encounter_facts(spark, folder)))


def known(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows with null tokens removed and the label added."""
    return with_label(normalise(raw(spark, folder)))


def encounters(spark: SparkSession, folder: str) -> DataFrame:
    return staged(spark, _name(folder, "encounters_clean"), lambda: clean(raw(spark, folder)))


def ruled(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows with the rule score."""
    return encounters(spark, folder).withColumn("risk_score", weighted_score(S.RULE_WEIGHTS))


def tested(spark: SparkSession, folder: str) -> DataFrame:
    """Clean rows with rule score and split."""
    return splits.group_split(ruled(spark, folder), PATIENT)


_MODELS: dict[tuple[str, str], ModelRun] = {}


def model_run(spark: SparkSession, folder: str) -> ModelRun:
    """One modelling run per session and folder, shared by the model queries."""
    key = (run_dir(spark), os.path.abspath(folder))
    if key not in _MODELS:
        _MODELS[key] = run_models(encounters(spark, folder))
    return _MODELS[key]


def columns_of(spark: SparkSession, folder: str, table: str, cols: list[str]) -> DataFrame:
    """Some columns of a given table."""
    return read_table(spark, folder, table).select(*cols)


# -------------------------------------------------------------- cleaning steps

@query
def null_tokens(spark, folder):
    return normalise(raw(spark, folder)).select(
        ID, "race", "weight", "payer_code", "medical_specialty", *S.DIAGNOSES,
        "max_glu_serum", "A1Cresult")


@query
def exclude_leakage(spark, folder):
    kept = filters.exclude_codes(raw(spark, folder), "discharge_disposition_id",
                                 S.EXPIRED_OR_HOSPICE_CODES)
    return kept.select(ID, "discharge_disposition_id")


@query
def exclude_invalid_gender(spark, folder):
    return filters.exclude_value(raw(spark, folder), "gender", "Unknown/Invalid").select(
        ID, "gender")


@query
def primary_diagnosis_known(spark, folder):
    grouped = known(spark, folder).select(ID, icd9_group("diag_1").alias("diag_1_group"))
    return grouped.filter(F.col("diag_1_group") != "Missing")


@query
def binary_label_of_class(spark, folder):
    return raw(spark, folder).select(ID, binary_label("readmitted", "<30").alias(LABEL))


@query
def fill_categories(spark, folder):
    filled = filters.fill_categories(known(spark, folder), S.ENCOUNTERS.fills)
    return filled.select(ID, "race", "A1Cresult", "max_glu_serum")


@query
def collapse_top_k(spark, folder):
    rows = known(spark, folder).select(ID, "medical_specialty", "payer_code")
    for col, (k, other) in S.ENCOUNTERS.top_k.items():
        rows = filters.collapse_top_k(rows, col, k, other)
    return rows


@query
def collapse_document_sources(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    return filters.collapse_top_k(docs, "source", 3, "other")


@query
def keep_top_specialties(spark, folder):
    rows = known(spark, folder).select(ID, "medical_specialty")
    return filters.keep_members(rows, "medical_specialty",
                                filters.top_values(rows, "medical_specialty", 10))


@query
def icd9_groups(spark, folder):
    grouped = filters.icd9_groups(known(spark, folder).select(ID, *S.DIAGNOSES), S.DIAGNOSES)
    return grouped.drop(*S.DIAGNOSES)


@query
def age_midpoint(spark, folder):
    return raw(spark, folder).select(
        ID, "age", band_lower("age").alias("age_lower"), band_midpoint("age").alias("age_numeric"))


@query
def ordinal_medications(spark, folder):
    rows = raw(spark, folder).select(ID, *[F.col(f"`{c}`") for c in S.KEPT_MEDICATIONS])
    return filters.ordinal_encode(rows, S.KEPT_MEDICATIONS, S.DOSAGE_LEVELS)


@query
def medication_counts(spark, folder):
    return medication_features(raw(spark, folder)).select(
        ID, "num_med_increased", "num_med_decreased", "change", "diabetesMed")


@query
def utilization(spark, folder):
    return utilization_features(raw(spark, folder)).select(
        ID, "service_utilization", "had_prior_inpatient",
        clip_upper("number_inpatient", 5).alias("number_inpatient_capped"),
        flag_ge("number_inpatient", 3).alias("triage_flag"),
        tier(row_sum(S.VISIT_COUNTS), S.UTILIZATION_TIERS, S.UTILIZATION_TIER_ELSE)
        .alias("utilization_tier"))


@query
def clean_full(spark, folder):
    return clean(raw(spark, folder))


@query
def audit_of_cleaning(spark, folder):
    return cleaning_audit(raw(spark, folder))


@query
def total_nulls(spark, folder):
    return profile.total_nulls(encounters(spark, folder))


# ------------------------------------------------------------------ rate tables

@query
def overall_rate(spark, folder):
    return rates.overall_rate(encounters(spark, folder), LABEL)


@query
def rate_by_diagnosis(spark, folder):
    return rates.rate_by(encounters(spark, folder), "diag_1_group", LABEL, share=True)


@query
def specialty_volume(spark, folder):
    return rates.rate_by(encounters(spark, folder), "medical_specialty", LABEL,
                         min_n=SPECIALTY_MIN, positives=False)


@query
def utilization_tiers(spark, folder):
    return rates.rate_by_tier(encounters(spark, folder), "service_utilization",
                              S.UTILIZATION_TIERS, S.UTILIZATION_TIER_ELSE, LABEL,
                              "utilization_tier")


@query
def length_of_stay(spark, folder):
    by = {"length_of_stay_days": "time_in_hospital"}
    return rates.rate_by(encounters(spark, folder), by, LABEL, positives=False, averages={
        "avg_medications": "num_medications", "avg_procedures": "num_procedures",
    }).orderBy("length_of_stay_days")


#: statements of the package's own scripts: query, script, number of the statement
SCRIPTS = [
    ("overall_rate", "rates.sql", 1), ("rate_by_diagnosis", "rates.sql", 2),
    ("specialty_volume", "rates.sql", 3), ("utilization_tiers", "utilization.sql", 1),
    ("length_of_stay", "utilization.sql", 2), ("segment_matrix", "utilization.sql", 3),
    ("admission_type_join", "admission.sql", 1), ("admission_source_join", "admission.sql", 2),
    ("medication_change", "medication.sql", 1), ("insulin_status", "medication.sql", 2),
]


def _script(file: str, number: int) -> Query:
    def run(spark, folder):
        catalog.register(spark, catalog.star_tables(encounters(spark, folder), {
            n: lookup(spark, n) for n in ("admission_type", "admission_source")}))
        text = {file: catalog.own_scripts()[file]}
        found = {r.number: r for r in catalog.run_scripts(spark, text)}[number]
        if found.error:
            raise ValueError(found.error)
        return found.df
    return run


for _name_, _file, _number in SCRIPTS:
    QUERIES[f"script_{_name_}"] = _script(_file, _number)


#: statements whose order is part of the answer: it is given as a column
ORDERED = [
    ("by_count", "ordering.sql", 1), ("by_hidden_sum", "ordering.sql", 2),
    ("by_case", "ordering.sql", 3), ("utilization_tiers", "utilization.sql", 1),
    ("medication_change", "medication.sql", 1),
]


def _ordered(file: str, number: int) -> Query:
    return lambda spark, folder: rank.with_place(_script(file, number)(spark, folder))


for _name_, _file, _number in ORDERED:
    QUERIES[f"ordered_{_name_}"] = _ordered(_file, _number)


@query
def ordered_by_list(spark, folder):
    """Age groups in a fixed order of their own, others after them."""
    counts = known(spark, folder).groupBy("age").agg(F.count(F.lit(1)).alias("n"))
    return rank.with_place(filters.order_by_list(counts, "age", ["[70-80)", "[60-70)", "[80-90)"]))


@query
def export_round_trip(spark, folder):
    """Rows by split, written as an export, replaced, and read back through its pointer."""
    path = f"{run_dir(spark)}/{_name(folder, 'export')}"
    rows = tested(spark, folder)
    sinks.publish_fact(rows.limit(10), path)
    sinks.publish_fact(rows, path)
    return readers.read_export(spark, path).groupBy("data_split").agg(
        F.count(F.lit(1)).alias("n"), F.sum(LABEL).alias("n_readmissions"))


@query
def summary_round_trip(spark, folder):
    """A nested summary written as JSON and read back."""
    table = scores_compared(spark, folder).select(
        F.col("score").alias("model"), "accuracy", "precision", "recall", "f1", "roc_auc",
        "top_decile_readmit_rate_pct", "pct_of_readmissions_captured", "lift_vs_random")
    doc = table.agg(F.collect_list(F.struct(*table.columns)).alias("model_comparison")).select(
        "model_comparison", F.lit("rule").alias("best_model"), F.struct(
            F.lit(0.5).alias("auc_without_race_payer"), F.lit(0.75).alias("auc_with_race_payer"),
            F.lit(0.25).alias("auc_uplift")).alias("fairness_check"))
    path = f"{run_dir(spark)}/{_name(folder, 'summary-json')}"
    sinks.write_summary(doc, path)
    return readers.read_summary(spark, path).select(
        F.inline("model_comparison"), "best_model", "fairness_check").select(
        "model", "roc_auc", "lift_vs_random", "best_model", "fairness_check.auc_uplift")


@query
def csv_round_trip(spark, folder):
    """Raw rows written as CSV, read back with the declared schema, cleaned and counted."""
    path = f"{run_dir(spark)}/{_name(folder, 'csv')}"
    sinks.write_csv(raw(spark, folder), path)
    return rates.overall_rate(clean(readers.read_encounters(spark, path)), LABEL)


@query
def dims_round_trip(spark, folder):
    """A dimension exported and read back, joined as the stage table is."""
    out = f"{run_dir(spark)}/{_name(folder, 'dims')}"
    sinks.export_dims({"admission_type": lookup(spark, "admission_type")}, out)
    dim = readers.read_lookup(spark, f"{out}/dim_admission_type", "admission_type_id")
    return rates.rate_by_dim(encounters(spark, folder), dim, "admission_type_id", LABEL,
                             "admission_type", min_n=200)


def _by_dim(spark, folder, name, out, **kw):
    return rates.rate_by_dim(encounters(spark, folder), lookup(spark, name), f"{name}_id",
                             LABEL, out, **kw)


@query
def admission_type_join(spark, folder):
    return _by_dim(spark, folder, "admission_type", "admission_type", min_n=200)


@query
def admission_source_join(spark, folder):
    return _by_dim(spark, folder, "admission_source", "admission_source", min_n=SOURCE_MIN)


@query
def discharge_left_join(spark, folder):
    return _by_dim(spark, folder, "discharge_disposition", "discharge_disposition", how="left")


@query
def source_left_join(spark, folder):
    return _by_dim(spark, folder, "admission_source", "admission_source", how="left")


@query
def segment_matrix(spark, folder):
    keys = {"diag_1_group": "diag_1_group", "utilization_tier": tier(
        "service_utilization", S.SEGMENT_TIERS, S.SEGMENT_TIER_ELSE)}
    return rates.segment_matrix(encounters(spark, folder), keys, LABEL, min_n=SEGMENT_MIN, k=10)


@query
def medication_change(spark, folder):
    status = F.when(F.col("change") == 1, "Medication changed").otherwise("No change")
    return rates.rate_by(encounters(spark, folder), {"med_change_status": status}, LABEL,
                         positives=False)


@query
def insulin_status(spark, folder):
    levels = {v: k for k, v in S.DOSAGE_LEVELS.items()}
    return rates.rate_by_decoded(encounters(spark, folder), "insulin", levels, LABEL,
                                 "insulin_status")


@query
def rate_by_age_band(spark, folder):
    return rates.rate_by_band(known(spark, folder), "age", LABEL)


@query
def rate_by_lab_keep_null(spark, folder):
    return rates.rate_by(known(spark, folder), "A1Cresult", LABEL, positives=False)


@query
def rate_by_lab_drop_null(spark, folder):
    return rates.rate_by(known(spark, folder), "A1Cresult", LABEL, positives=False,
                         drop_null=True).orderBy("readmit_rate_pct", "A1Cresult")


@query
def rate_by_prior_inpatient(spark, folder):
    return rates.rate_by(encounters(spark, folder),
                         {"had_prior_inpatient": flag_gt("number_inpatient", 0)}, LABEL)


@query
def rate_at_eight_visits(spark, folder):
    return rates.rate_by(encounters(spark, folder),
                         {"eight_or_more": flag_ge("service_utilization", 8)}, LABEL)


@query
def capped_rates(spark, folder):
    return rates.capped_rate(known(spark, folder), S.VISIT_COUNTS, 5, LABEL)


@query
def leakage_check(spark, folder):
    return rates.leakage_check(known(spark, folder), "discharge_disposition_id",
                               S.EXPIRED_OR_HOSPICE_CODES, LABEL)


@query
def kpis(spark, folder):
    return rates.kpis(encounters(spark, folder), LABEL, "time_in_hospital")


@query
def kpis_of_slice(spark, folder):
    rows = filters.slice_by(encounters(spark, folder), gender="Female",
                            diag_1_group=["Circulatory", "Respiratory"], admission_type_id=1)
    return rates.kpis(rows, LABEL, "time_in_hospital")


@query
def label_distribution(spark, folder):
    return rates.value_counts(raw(spark, folder), "readmitted")


@query
def class_balance(spark, folder):
    return rates.class_balance(encounters(spark, folder), LABEL)


@query
def quality_by_source(spark, folder):
    """Second data set: label rate per document source."""
    docs = read_table(spark, folder, "documents").select("doc_id", "source")
    labelled = docs.join(read_table(spark, folder, "labels"), "doc_id")
    return rates.rate_by(labelled, "source", "quality", share=True)


# ------------------------------------------------------------ ranks and deciles

@query
def ntile_gains(spark, folder):
    return rank.gains_table(ruled(spark, folder), "risk_score", LABEL, ID)


@query
def cumulative_gains(spark, folder):
    return rank.cumulative_gains(rank.gains_table(ruled(spark, folder), "risk_score", LABEL, ID))


@query
def ntile_deciles(spark, folder):
    rows = rank.assign_tile(ruled(spark, folder), "risk_score", ID, "risk_decile")
    return rows.select(ID, "risk_score", "risk_decile")


@query
def qcut_deciles(spark, folder):
    rows = rank.assign_tile(ruled(spark, folder), "risk_score", ID, "risk_decile", rule="qcut")
    return rows.select(ID, "risk_score", "risk_decile")


@query
def global_rank(spark, folder):
    return rank.global_rank(ruled(spark, folder).select(ID, "risk_score"), "risk_score", ID)


@query
def order_price_rank(spark, folder):
    """A continuous score: exact rank of every order by total price."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return rank.global_rank(orders, "o_totalprice", "o_orderkey")


@query
def qcut_lift(spark, folder):
    return rank.top_decile_lift(ruled(spark, folder), "risk_score", LABEL, ID)


@query
def triage_rule_lift(spark, folder):
    return rank.rule_flag_lift(encounters(spark, folder), "number_inpatient", 3, LABEL)


@query
def lift_measures(spark, folder):
    rows = rank.assign_tile(ruled(spark, folder), "risk_score", ID, "risk_decile", rule="qcut")
    return rank.lift_measures(rows, "risk_decile", LABEL)


@query
def risk_bands(spark, folder):
    rows = serve.with_deciles_and_bands(tested(spark, folder), ID, "risk_score")
    return rows.select(ID, "data_split", "is_out_of_sample_prediction",
                       "predicted_risk_decile", "risk_band")


@query
def band_rates(spark, folder):
    rows = serve.with_deciles_and_bands(tested(spark, folder), ID, "risk_score")
    return rates.rate_by(splits.out_of_sample(rows), "risk_band", LABEL)


@query
def rule_worklist(spark, folder):
    columns = [ID, PATIENT, "risk_score", "diag_1_group", "age_numeric", "number_inpatient",
               "service_utilization", "time_in_hospital", "discharge_disposition_id",
               "medical_specialty", LABEL]
    return serve.worklist(tested(spark, folder), 200, columns, "risk_score")


@query
def score_extremes(spark, folder):
    return rank.score_extremes(ruled(spark, folder), "risk_score", ID)


@query
def sample_n(spark, folder):
    rows = splits.out_of_sample(tested(spark, folder)).select(ID, "risk_score")
    return rank.sample_n(rows, 2000, 42, ID)


# --------------------------------------------------------------------- profile

@query
def null_report(spark, folder):
    return profile.null_report(normalise(raw(spark, folder)))


@query
def describe_numeric(spark, folder):
    return profile.describe_numeric(raw(spark, folder), S.PROFILE_NUMERIC)


@query
def iqr_outliers(spark, folder):
    return profile.iqr_outliers(raw(spark, folder), S.PROFILE_NUMERIC)


@query
def box_stats(spark, folder):
    return profile.box_stats(raw(spark, folder), S.PROFILE_NUMERIC)


@query
def histogram(spark, folder):
    return profile.histogram(raw(spark, folder), S.PROFILE_NUMERIC)


@query
def corr_matrix(spark, folder):
    return profile.corr_matrix(known(spark, folder), [*S.PROFILE_NUMERIC, LABEL])


@query
def corr_with_label(spark, folder):
    return profile.corr_with(known(spark, folder), S.PROFILE_NUMERIC, LABEL)


@query
def cardinality(spark, folder):
    return profile.cardinality(known(spark, folder), [PATIENT, *S.DIAGNOSES])


@query
def category_counts(spark, folder):
    return profile.category_counts(encounters(spark, folder), S.FEATURE_CATEGORICAL)


@query
def near_zero_variance(spark, folder):
    return profile.near_zero_variance(
        known(spark, folder), [*S.KEPT_MEDICATIONS, *S.RARE_MEDICATIONS])


@query
def describe_lineitem(spark, folder):
    """Prices in whole hundredths, whose sums are exact in any order of rows."""
    rows = columns_of(spark, folder, "lineitem", PRICE_COLUMNS)
    cents = rows.select(*[F.round(F.col(c) * 100).cast("long").alias(c) for c in PRICE_COLUMNS])
    return profile.describe_numeric(cents, PRICE_COLUMNS)


@query
def iqr_lineitem(spark, folder):
    return profile.iqr_outliers(columns_of(spark, folder, "lineitem", PRICE_COLUMNS), PRICE_COLUMNS)


@query
def histogram_lineitem(spark, folder):
    return profile.histogram(columns_of(spark, folder, "lineitem", ["l_quantity"]),
                             ["l_quantity"], 10)


@query
def corr_lineitem(spark, folder):
    return profile.corr_matrix(columns_of(spark, folder, "lineitem", PRICE_COLUMNS), PRICE_COLUMNS)


@query
def describe_documents(spark, folder):
    return profile.describe_numeric(read_table(spark, folder, "documents"), ["n_chars"])


# ----------------------------------------------------------- splits and metrics

@query
def group_split_hash(spark, folder):
    return splits.group_split(encounters(spark, folder), PATIENT).select(
        ID, PATIENT, "data_split", "is_out_of_sample_prediction")


@query
def group_split_exact(spark, folder):
    return splits.group_split(encounters(spark, folder), PATIENT, exact=True).select(
        ID, PATIENT, "data_split", "is_out_of_sample_prediction")


@query
def split_overlap(spark, folder):
    return splits.split_overlap(tested(spark, folder), PATIENT)


@query
def event_user_split(spark, folder):
    events = read_table(spark, folder, "events").select("event_id", "user_id")
    return splits.group_split(events, "user_id", 0.3, 7, exact=True)


@query
def class_weights(spark, folder):
    rows = encounters(spark, folder).select(ID, LABEL)
    weighted = models.add_class_weight(rows, LABEL, "balanced")
    return weighted.select(ID, F.round("class_weight", 6).alias("class_weight"))


@query
def binary_metrics(spark, folder):
    rows = ruled(spark, folder).withColumn("flagged", flag_ge("risk_score", RULE_CUTOFF))
    return metrics.binary_metrics(rows, LABEL, "flagged")


@query
def roc_auc(spark, folder):
    return metrics.roc_auc(ruled(spark, folder), "risk_score", LABEL)


def _two_scores(spark, folder):
    """Two fixed scores with a class each, as a long table (score, value, flagged)."""
    return ruled(spark, folder).select(ID, LABEL, F.inline(F.array(
        F.struct(F.lit("rule").alias("score"), F.col("risk_score").cast("double").alias("value"),
                 flag_ge("risk_score", RULE_CUTOFF).alias("flagged")),
        F.struct(F.lit("visits").alias("score"),
                 F.col("service_utilization").cast("double").alias("value"),
                 flag_ge("service_utilization", 3).alias("flagged")))))


@query
def scores_compared(spark, folder):
    """What a model comparison measures, for two scores that SQL knows."""
    return metrics.evaluate_by(_two_scores(spark, folder), "score", "value", LABEL, "flagged", ID)


@query
def scores_lift(spark, folder):
    rows = ruled(spark, folder)
    return models.compare_lift(rows, {"rule": "risk_score", "visits": "service_utilization"},
                               LABEL, ID)


@query
def event_types_compared(spark, folder):
    """The same measures per event type: how well a value tells the later half of the events."""
    later = F.col("event_id") % 2
    rows = read_table(spark, folder, "events").select(
        "event_id", "event_type", F.col("value").cast("double").alias("value"),
        later.cast("int").alias("later"), flag_ge("value", 50).alias("flagged"))
    return metrics.evaluate_by(rows, "event_type", "value", "later", "flagged", "event_id")


@query
def roc_curve(spark, folder):
    return metrics.roc_curve(ruled(spark, folder), "risk_score", LABEL, 100)


def _purchases(spark, folder):
    return read_table(spark, folder, "events").select(
        "event_id", "value", binary_label("event_type", "purchase").alias("bought"))


@query
def events_roc_auc(spark, folder):
    return metrics.roc_auc(_purchases(spark, folder), "value", "bought")


@query
def events_roc_full(spark, folder):
    return metrics.roc_curve(_purchases(spark, folder), "value", "bought")


def _gappy(spark, folder):
    """Events with nulls and NaN in a number, nulls in a code and in a text."""
    at = F.col("event_id")
    return columns_of(spark, folder, "events", ["event_id", "value"]).select(
        at.alias("id"),
        F.when(at % 7 == 0, F.lit(None)).when(at % 7 == 3, F.lit(float("nan")))
        .otherwise(F.col("value").cast("double")).alias("gaps"),
        F.when(at % 5 != 0, at % 20).alias("code"),
        F.when(at % 6 != 0, F.concat(F.lit("w"), (at % 9).cast("string"))).alias("word"))


@query
def gappy_histogram(spark, folder):
    return profile.histogram(_gappy(spark, folder), ["gaps"], 12)


@query
def gappy_outliers(spark, folder):
    return profile.iqr_outliers(_gappy(spark, folder), ["gaps"])


@query
def gappy_extremes(spark, folder):
    return rank.score_extremes(_gappy(spark, folder), "gaps", "id")


@query
def gappy_codes(spark, folder):
    return filters.exclude_codes(_gappy(spark, folder), "code", [11, 13]).select("id", "code")


@query
def gappy_values(spark, folder):
    return filters.exclude_value(_gappy(spark, folder), "word", "w3").select("id", "word")


@query
def events_roc_curve(spark, folder):
    return metrics.roc_curve(_purchases(spark, folder), "value", "bought", 50)


@query
def events_gains(spark, folder):
    return rank.gains_table(_purchases(spark, folder), "value", "bought", "event_id", rule="qcut")


@query
def reliable_features(spark, folder):
    return explain.reliable_features(encounters(spark, folder), S.FEATURE_NUMERIC,
                                     S.FEATURE_CATEGORICAL, RELIABLE_MIN)


@query
def unreliable_features(spark, folder):
    rows = encounters(spark, folder)
    names = profile.category_counts(rows, S.FEATURE_CATEGORICAL).select(
        F.col("name").alias("feature"))
    return explain.unreliable_features(names, reliable_features(spark, folder))


@query
def rule_attribution(spark, folder):
    """Mean absolute attribution of the rule score, which is a linear model."""
    return explain.global_importance(explain.linear_attribution(
        encounters(spark, folder), S.RULE_WEIGHTS, ID))


#: a small tree, as leaves (value, places in TREE_FEATURES, low, high, share)
TREE_FEATURES = ["number_inpatient", "time_in_hospital", "num_medications"]
INF = float("inf")
TREE_LEAVES = [
    (0.1, [0, 1], [-INF, -INF], [1.0, 5.0], [0.8, 0.4]),
    (0.2, [0, 1], [-INF, 5.0], [1.0, INF], [0.8, 0.6]),
    (0.3, [0, 2], [1.0, -INF], [INF, 40.0], [0.2, 0.5]),
    (0.6, [0, 2], [1.0, 40.0], [INF, INF], [0.2, 0.5]),
    (0.05, [1], [9.0], [INF], [0.3]),
]


def _fixed_tree(spark, folder, leaves_per_block=2):
    rows = encounters(spark, folder).select(ID, F.array(*[
        F.col(c).cast("double") for c in TREE_FEATURES]).alias("x"))
    leaves = spark.createDataFrame(
        [(0, n, *leaf) for n, leaf in enumerate(TREE_LEAVES)], explain.LEAVES)
    return explain.attribution(rows, leaves, ID, leaves_per_block)


def _staged_tree(spark, folder):
    """The tree's attribution as a table, for queries that read it more than once."""
    return staged(spark, _name(folder, "fixed_tree"), lambda: _fixed_tree(spark, folder))


@query
def fixed_tree_attribution(spark, folder):
    """Attribution of a tree that SQL can follow, its leaves dealt over several blocks."""
    return _fixed_tree(spark, folder).select(
        ID, F.round("base", 6).alias("base"), F.round("margin", 6).alias("margin"),
        *[F.round(F.get("shap", F.lit(i)), 6).alias(c) for i, c in enumerate(TREE_FEATURES)])


@query
def fixed_tree_importance(spark, folder):
    """Ranking of the tree's features, with the place in it."""
    long = explain.long_attribution(_fixed_tree(spark, folder), TREE_FEATURES, ID)
    reliable = spark.createDataFrame([(c,) for c in TREE_FEATURES[:2]], "feature string")
    return rank.ranked_top_k(
        explain.reliable_importance(explain.global_importance(long), reliable),
        [F.desc("mean_abs_shap"), F.col("feature")], len(TREE_FEATURES), "place")


@query
def fixed_tree_local(spark, folder):
    """What moved the row with the smallest id, strongest first, with the place."""
    rows = _staged_tree(spark, folder)
    least = rows.agg(F.min(ID)).first()[0]
    local = explain.local_explanation(
        explain.long_attribution(rows, TREE_FEATURES, ID), least, ID, 2)
    return rank.ranked_top_k(local.withColumn("shap", F.round("shap", 6)),
                             [F.desc(F.abs("shap")), F.col("feature")], 2, "place")


# ----------------------------------------------------------------------- models

@query
def model_comparison(spark, folder):
    return model_run(spark, folder).comparison


@query
def model_performance(spark, folder):
    run = model_run(spark, folder)
    return serve.model_performance_table(run.comparison, run.summary)


@query
def fairness_check(spark, folder):
    return serve.fairness_table(model_run(spark, folder).summary)


@query
def feature_importance(spark, folder):
    run = model_run(spark, folder)
    listed = models.feature_importance(run.model)
    rows = spark.createDataFrame(listed, "feature string, importance double")
    return rows.orderBy(F.desc("importance"), "feature").limit(10)


@query
def scored_fact(spark, folder):
    return model_run(spark, folder).fact


@query
def model_worklist(spark, folder):
    return serve.worklist(model_run(spark, folder).fact)


@query
def band_validation(spark, folder):
    return serve.band_validation(model_run(spark, folder).fact, LABEL)


@query
def lift_vs_rule(spark, folder):
    fact = splits.out_of_sample(model_run(spark, folder).fact).withColumn(
        "risk_score", weighted_score(S.RULE_WEIGHTS))
    return models.compare_lift(fact, {"model": serve.RISK, "rule": "risk_score"}, LABEL, ID)


def _explained(spark, folder):
    """Attribution of all test rows, staged once, and the ids of the two extreme ones."""
    run = model_run(spark, folder)
    test = splits.out_of_sample(run.fact)
    ends = rank.score_extremes(test, serve.RISK, ID).first()
    ids = [ends["highest_id"], ends["lowest_id"]]
    names = models.feature_names(run.model, *S.ENCOUNTERS.features())

    def build():
        train = run.table.filter(F.col("data_split") == "train")
        return explain.shap_values(run.model, test, run.model_dir, background=train)

    return staged(spark, _name(folder, "shap"), build), names, ids


def _attribution(spark, folder):
    shap, names, _ = _explained(spark, folder)
    return explain.long_attribution(shap, names, ID)


@query
def shap_global(spark, folder):
    return explain.global_importance(_attribution(spark, folder))


@query
def shap_reliable(spark, folder):
    listed = reliable_features(spark, folder)
    return explain.reliable_importance(
        explain.global_importance(_attribution(spark, folder)), listed)


@query
def shap_local(spark, folder):
    shap, names, (high, low) = _explained(spark, folder)
    long = explain.reliable_rows(
        explain.long_attribution(shap.filter(F.col(ID).isin(high, low)), names, ID),
        reliable_features(spark, folder))
    return explain.local_explanation(long, high, ID).withColumn("kind", F.lit("highest")).unionByName(
        explain.local_explanation(long, low, ID).withColumn("kind", F.lit("lowest")))


# ------------------------------- what holds for any fitted model, whatever its scores

@query
def scored_sizes(spark, folder):
    """Rows per split, decile and band: the split and the decile rule decide them."""
    return model_run(spark, folder).fact.groupBy(
        "data_split", serve.DECILE, serve.BAND).agg(F.count(F.lit(1)).alias("n"))


@query
def model_auc_mirrored(spark, folder):
    """The areas under the curves of a score and of its negative add up to one."""
    test = splits.out_of_sample(model_run(spark, folder).fact).withColumn(
        "mirrored", -F.col(serve.RISK))
    one, other = (metrics.roc_auc(test, c, LABEL).first()[0] for c in (serve.RISK, "mirrored"))
    return spark.range(1).select(F.round(F.lit(one + other), 5).alias("both"))


@query
def model_reloaded(spark, folder):
    """The saved best model scores every row as the one in memory does."""
    run = model_run(spark, folder)
    a, b = (serve.score_fact(run.table, m) for m in (run.model, readers.load_model(run.model_dir)))
    return metrics.compare_scores(a, b, ID, serve.RISK)


@query
def shap_adds_up(spark, folder):
    """Base and attributions of every test row add up to what the model says."""
    shap = _explained(spark, folder)[0]
    total = F.col("base") + F.aggregate("shap", F.lit(0.0), lambda a, v: a + v)
    return shap.agg(F.count(F.lit(1)).alias("n"),
                    F.count_if(F.abs(total - F.col("margin")) > 1e-6).alias("n_off"))
