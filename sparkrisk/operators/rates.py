"""Label rates by group, with volume thresholds, shares and dimension labels.

Every function aggregates the fact table once with map-side partial sums; what is
joined, filtered and sorted afterwards is one row per group. A dimension is joined to
the grouped result, never to the fact table, so a hot key costs nothing extra.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrisk.functions import (
    as_column, band_lower, clip_upper, decode, divide, mean_1dp, quoted, rate_pct, tier,
)

N, POS, RATE = "n_encounters", "n_readmissions", "readmit_rate_pct"
SHARE = "pct_of_all_encounters"


def _count() -> Column:
    return F.count(F.lit(1))


def _sum(col: str | Column) -> Column:
    return F.coalesce(F.sum(as_column(col)).cast("long"), F.lit(0).cast("long"))


def overall_rate(df: DataFrame, label: str) -> DataFrame:
    """Rows, positives and rate of the whole table."""
    totals = df.agg(_count().alias("total_encounters"), _sum(label).alias("total_readmissions"))
    return totals.withColumn(RATE, rate_pct("total_readmissions", "total_encounters"))


def share_of_total(grouped: DataFrame, df: DataFrame, n: str = N, out: str = SHARE) -> DataFrame:
    """Percent of all rows of ``df`` in each group, the total being a scalar subquery."""
    total = df.agg(_count()).scalar()
    return grouped.withColumn(out, rate_pct(n, total))


def rate_by(df: DataFrame, by: str | Mapping[str, str | Column] | Sequence[str], label: str, *,
            min_n: int = 0, share: bool = False, drop_null: bool = False,
            averages: Mapping[str, str] | None = None, positives: bool = True) -> DataFrame:
    """Count, positives and rate per group, highest rate first.

    ``by`` is a column, several columns, or ``{name: expression}``. ``averages`` adds
    one-decimal means of whole-number columns as ``{output: input}``. The null group is
    kept unless ``drop_null``.
    """
    if isinstance(by, str):
        by = {by: by}
    elif not isinstance(by, Mapping):
        by = {c: c for c in by}
    keys = list(by)
    averages = dict(averages or {})
    rows = df.select(
        *[as_column(e).alias(name) for name, e in by.items()], as_column(label).alias("_label"),
        *[as_column(c).cast("long").alias(f"_{out}") for out, c in averages.items()])
    if drop_null:
        rows = rows.dropna(subset=[quoted(k) for k in keys])
    grouped = rows.groupBy(*[quoted(k) for k in keys]).agg(
        _count().alias(N), _sum("_label").alias(POS),
        *[F.sum(f"_{out}").alias(f"_s_{out}") for out in averages],
        *[F.count(f"_{out}").alias(f"_n_{out}") for out in averages])
    if min_n:
        grouped = grouped.filter(F.col(N) >= min_n)
    grouped = grouped.withColumn(RATE, rate_pct(POS, N))
    if share:
        grouped = share_of_total(grouped, df)
    for out in averages:
        grouped = grouped.withColumn(out, mean_1dp(f"_s_{out}", f"_n_{out}"))
    out_cols = [quoted(k) for k in keys] + [N] + ([POS] if positives else []) + [RATE]
    out_cols += ([SHARE] if share else []) + [quoted(a) for a in averages]
    return grouped.select(*out_cols).orderBy(F.desc(RATE), *[quoted(k) for k in keys])


def rate_by_dim(df: DataFrame, dim: DataFrame, key: str, label: str, out: str, *,
                min_n: int = 0, how: str = "inner") -> DataFrame:
    """Rate per dimension description; ``how='left'`` keeps keys the dimension lacks.

    The fact table is reduced to one row per key before the join, then ids that share a
    description are added up.
    """
    per_key = df.groupBy(quoted(key)).agg(_count().alias("_n"), _sum(label).alias("_pos"))
    named = per_key.join(dim.select(quoted(key), F.col("description").alias(out)), key, how)
    grouped = named.groupBy(out).agg(F.sum("_n").alias(N), F.sum("_pos").alias(POS))
    if min_n:
        grouped = grouped.filter(F.col(N) >= min_n)
    return grouped.select(out, N, rate_pct(POS, N).alias(RATE)).orderBy(F.desc(RATE), out)


def rate_by_tier(df: DataFrame, col: str, tiers: Sequence[tuple], otherwise: str, label: str,
                 out: str) -> DataFrame:
    """Rate per range tier, in the order of the smallest value in the tier."""
    rows = df.select(tier(col, tiers, otherwise).alias(out), as_column(col).alias("_v"),
                     as_column(label).alias("_label"))
    grouped = rows.groupBy(out).agg(_count().alias(N), _sum("_label").alias(POS),
                                    F.min("_v").alias("_first"))
    return grouped.withColumn(RATE, rate_pct(POS, N)).orderBy("_first", out).drop("_first")


def segment_matrix(df: DataFrame, keys: Mapping[str, str | Column], label: str, *,
                   min_n: int, k: int | None = None) -> DataFrame:
    """Rate of every combination of ``keys`` with enough rows; the ``k`` highest if given."""
    out = rate_by(df, keys, label, min_n=min_n, positives=False)
    return out.limit(k) if k else out


def rate_by_decoded(df: DataFrame, col: str, mapping: Mapping, label: str, out: str) -> DataFrame:
    """Group by a code, show its text, keep the order of the codes."""
    grouped = df.groupBy(as_column(col).alias("_code")).agg(
        _count().alias(N), _sum(label).alias(POS))
    return grouped.orderBy("_code").select(
        decode("_code", mapping).alias(out), N, rate_pct(POS, N).alias(RATE))


def rate_by_band(df: DataFrame, col: str, label: str) -> DataFrame:
    """Rate per text band in the order of the bands."""
    return rate_by(df, col, label, drop_null=True, positives=False).orderBy(
        band_lower(col), quoted(col))


def capped_rate(df: DataFrame, cols: Sequence[str], cap: int, label: str) -> DataFrame:
    """Rate per value of each count column, values above ``cap`` together."""
    long = df.select(
        F.inline(F.array(*[
            F.struct(F.lit(c).alias("feature"), clip_upper(c, cap).cast("int").alias("capped"),
                     as_column(label).alias("_label")) for c in cols])))
    grouped = long.filter(F.col("capped").isNotNull()).groupBy("feature", "capped").agg(
        _count().alias(N), _sum("_label").alias(POS))
    return grouped.select("feature", "capped", N, rate_pct(POS, N).alias(RATE)).orderBy(
        "feature", "capped")


def leakage_check(df: DataFrame, col: str, codes: Sequence, label: str) -> DataFrame:
    """Rows with a listed code: how many, what share, and their label rate."""
    listed = F.coalesce(as_column(col).isin(*codes), F.lit(False))
    one = df.agg(_count().alias("_all"), F.count_if(listed).alias("n_masked"),
                 F.coalesce(F.sum(F.when(listed, as_column(label))).cast("long"),
                            F.lit(0)).alias("_pos"))
    return one.select("n_masked", rate_pct("n_masked", "_all").alias("pct_of_total"),
                      rate_pct("_pos", "n_masked").alias("label_rate_pct"))


def kpis(df: DataFrame, label: str, los: str) -> DataFrame:
    """Headline measures: rows, positives, rate as a fraction, average stay."""
    one = df.agg(_count().alias("total_encounters"), _sum(label).alias("total_readmissions"),
                 _sum(los).alias("_los"), F.count(as_column(los)).alias("_n_los"))
    return one.select(
        "total_encounters", "total_readmissions",
        F.round(divide("total_readmissions", "total_encounters"), 6).alias("readmission_rate"),
        F.round(divide("_los", "_n_los"), 6).alias("avg_length_of_stay"))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Frequency and percent of every value, most frequent first; null left out."""
    known = df.filter(as_column(col).isNotNull())
    grouped = known.groupBy(quoted(col)).agg(_count().alias("n"))
    total = known.agg(_count()).scalar()
    return grouped.withColumn("pct", rate_pct("n", total)).orderBy(F.desc("n"), quoted(col))


def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Positives, negatives and the weight that balances them."""
    one = df.agg(_sum(label).alias("n_positive"), _count().alias("_n"))
    neg = F.col("_n") - F.col("n_positive")
    return one.select("n_positive", neg.alias("n_negative"),
                      F.round(F.try_divide(neg.cast("double"), F.col("n_positive").cast("double")),
                              6).alias("positive_weight"))
