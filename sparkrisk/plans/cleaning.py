"""Raw to clean encounters as one logical plan, and its audit as one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.functions import (
    as_column, band_midpoint, binary_label, flag_gt, matches, ordinal, quoted, rate_pct,
    row_count_eq, row_sum,
)
from sparkrisk.operators.filters import (
    collapse_top_k, exclude_codes, exclude_value, fill_categories, icd9_groups, null_tokens,
    top_values,
)
from sparkrisk.spec import CLEAN_SCHEMA, DIAGNOSES, ENCOUNTERS, VISIT_COUNTS, EncounterSpec


def normalise(raw: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """Null tokens removed; lab columns have a second token for 'not ordered'."""
    return null_tokens(raw, spec.null_tokens,
                       per_column={c: spec.lab_null_tokens for c in spec.lab_columns})


def with_label(df: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    return df.withColumn(spec.label, binary_label(spec.raw_label, spec.positive))


def diagnosis_groups(df: DataFrame) -> DataFrame:
    """Group the three diagnosis codes; rows without a primary diagnosis go."""
    present = df.filter(F.col("diag_1").isNotNull())
    return icd9_groups(present, DIAGNOSES).drop(*DIAGNOSES)


def medication_features(df: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """Counts of raised and lowered doses, read from the text levels, then ordinal codes."""
    return df.withColumns({
        "num_med_increased": row_count_eq(spec.medications, "Up"),
        "num_med_decreased": row_count_eq(spec.medications, "Down"),
        "change": binary_label("change", "Ch"),
        "diabetesMed": binary_label("diabetesMed", "Yes"),
        **{c: ordinal(c, spec.dosage) for c in spec.medications},
    })


def utilization_features(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "service_utilization": row_sum(VISIT_COUNTS),
        "had_prior_inpatient": flag_gt("number_inpatient", 0),
    })


def clean(raw: DataFrame, spec: EncounterSpec = ENCOUNTERS,
          frozen_top: dict[str, list] | None = None) -> DataFrame:
    """Every cleaning step in order, lazily.

    The top-K lists count all rows left after the leakage filter, that is before the
    diagnosis and gender filters. ``frozen_top`` replaces the counting by given lists
    (needed on streams, where the lists of the batch table must be kept).
    """
    known = exclude_codes(normalise(raw, spec), spec.leakage_column, spec.leakage_codes)
    df = with_label(known, spec).drop(spec.raw_label, *spec.dropped)
    df = fill_categories(df, spec.fills)
    for col, (k, other) in spec.top_k.items():
        if frozen_top is None:
            df = collapse_top_k(df, col, k, other, population=known)
        else:
            kept = matches(as_column(col).isin(*frozen_top[col]))
            df = df.withColumn(col, F.when(kept, as_column(col)).otherwise(other))
    df = diagnosis_groups(df)
    df = df.withColumn("age_numeric", band_midpoint("age")).drop("age")
    df = medication_features(df, spec)
    df = utilization_features(exclude_value(df, "gender", spec.invalid_gender))
    return df.select(*[quoted(f.name) for f in CLEAN_SCHEMA.fields])


def top_lists(raw: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> dict[str, list]:
    """The top-K values of each collapsed column (at most K values each)."""
    known = exclude_codes(normalise(raw, spec), spec.leakage_column, spec.leakage_codes)
    return {col: [r[0] for r in top_values(known, col, k).collect()]
            for col, (k, _) in spec.top_k.items()}


def cleaning_audit(raw: DataFrame, spec: EncounterSpec = ENCOUNTERS) -> DataFrame:
    """Rows in, removed and left per step, with the label count of the rows left.

    One pass: each step is a predicate, each row knows the first step that removes it.
    """
    df = with_label(normalise(raw, spec), spec)
    steps = [
        ("leakage", matches(as_column(spec.leakage_column).isin(*spec.leakage_codes))),
        ("missing_primary_diagnosis", F.col("diag_1").isNull()),
        ("invalid_gender", as_column("gender").eqNullSafe(F.lit(spec.invalid_gender))),
    ]
    alive, aggs = F.lit(True), []
    for i, (_, removes) in enumerate(steps):
        aggs += [F.count_if(alive).alias(f"in_{i}"),
                 F.count_if(alive & removes).alias(f"out_{i}"),
                 F.sum(F.when(alive & ~removes, as_column(spec.label)).otherwise(0))
                  .alias(f"pos_{i}")]
        alive = alive & ~removes
    totals = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(i + 1).alias("step_no"), F.lit(name).alias("step"),
                 F.col(f"in_{i}").alias("rows_in"), F.col(f"out_{i}").alias("rows_removed"),
                 F.col(f"pos_{i}").alias("n_positive"))
        for i, (name, _) in enumerate(steps)])
    out = totals.select(F.inline(rows))
    left = F.col("rows_in") - F.col("rows_removed")
    return out.select(
        "step_no", "step", "rows_in", "rows_removed", left.alias("rows_left"),
        rate_pct("rows_removed", "rows_in").alias("removed_pct"),
        rate_pct("n_positive", left).alias("label_rate_pct"))
