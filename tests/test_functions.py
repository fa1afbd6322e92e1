"""Column builders on hand-written rows: boundaries, nulls, rounding."""

import pytest
from pyspark.sql import functions as F

from sparkrisk import functions as X
from sparkrisk import spec as S
from sparkrisk.operators import filters


def column(spark, values, expr, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


ICD9 = {
    None: "Missing", "V27": "Other", "E849": "Other", "v27": "Other", "abc": "Other",
    "1d": "Other", "1e3": "Other", "139": "Other", "140": "Neoplasms", "239": "Neoplasms",
    "239.5": "Other", "249.9": "Other", "250": "Diabetes", "250.83": "Diabetes", "251": "Other",
    "389": "Other", "390": "Circulatory", "459": "Circulatory", "459.5": "Other",
    "460": "Respiratory", "519": "Respiratory", "520": "Digestive", "579": "Digestive",
    "580": "Genitourinary", "629": "Genitourinary", "709": "Other", "710": "Musculoskeletal",
    "739": "Musculoskeletal", "785": "Circulatory", "785.1": "Other", "786": "Respiratory",
    "787": "Digestive", "788": "Genitourinary", "789": "Other", "800": "Injury", "999": "Injury",
    "999.1": "Other", "": "Other", "1e2.5": "Other", "4.1e2": "Circulatory", " 410 ": "Circulatory",
}


def test_icd9_groups_at_every_boundary(spark):
    assert column(spark, list(ICD9), X.icd9_group("v")) == list(ICD9.values())
    df = spark.createDataFrame([(k,) for k in ICD9], "v string")
    pairs = {r["v"]: r["v_group"] for r in filters.icd9_groups(df, ["v"]).collect()}
    assert pairs == ICD9


def test_bands(spark):
    values = ["[0-10)", "[90-100)", None, "adult"]
    assert column(spark, values, X.band_midpoint("v")) == [5.0, 95.0, None, None]
    assert column(spark, values, X.band_lower("v")) == [0, 90, None, None]


def test_tier_null_falls_to_else(spark):
    tiers = X.tier("v", S.UTILIZATION_TIERS, S.UTILIZATION_TIER_ELSE)
    got = column(spark, [0, 1, 2, 3, 5, 6, None], tiers, "v int")
    assert [g[0] for g in got] == ["0", "1", "1", "3", "3", "6", "6"]


def test_right_closed_bins(spark):
    got = column(spark, [0, 1, 2, 3, 5, 6, 10, 11, None], X.cut("v", S.RISK_BANDS), "v int")
    assert [g and g.split()[0] for g in got] == [
        None, "High", "High", "Medium", "Medium", "Low", "Low", None, None]


def test_ordinal_and_counts(spark):
    values = ["No", "Down", "Steady", "Up", "Sideways", None]
    assert column(spark, values, X.ordinal("v", S.DOSAGE_LEVELS)) == [0, 1, 2, 3, None, None]
    assert column(spark, values, X.row_count_eq(["v", "v"], "Up")) == [0, 0, 0, 2, 0, 0]
    assert column(spark, values, X.binary_label("v", "Up")) == [0, 0, 0, 1, 0, 0]


def test_flags_and_caps_keep_null_semantics(spark):
    values = [0, 1, 3, 9, None]
    assert column(spark, values, X.flag_gt("v", 0), "v int") == [0, 1, 1, 1, 0]
    assert column(spark, values, X.flag_ge("v", 3), "v int") == [0, 0, 1, 1, 0]
    assert column(spark, values, X.clip_upper("v", 5), "v int") == [0, 1, 3, 5, None]
    assert column(spark, values, X.row_sum(["v", "v"]), "v int") == [0, 2, 6, 18, None]


@pytest.mark.parametrize("num,den,want", [
    (1, 800, 0.13), (201, 20000, 1.01), (1, 3, 33.33), (0, 5, 0.0), (3, 0, None),
    (11309, 99320, 11.39), (10 ** 11, 3 * 10 ** 11, 33.33),
])
def test_rates_round_half_up_on_integers(spark, num, den, want):
    row = spark.createDataFrame([(num, den)], "a long, b long")
    assert row.select(X.rate_pct("a", "b")).first()[0] == want


def test_mean_and_divide(spark):
    row = spark.createDataFrame([(25, 20, 0)], "a long, b long, z long")
    got = row.select(X.mean_1dp("a", "b"), X.divide("a", "z", -1), X.divide("a", "b")).first()
    assert tuple(got) == (1.3, -1.0, 1.25)


def test_rounding_ignores_summation_noise(spark):
    values = [0.0499185, 0.04991849999999999, 0.04991850000000001, 0.0499184, -2.5e-7, None,
              float("nan"), 38000.1234565]
    got = column(spark, values, X.round_stable("v"), "v double")
    assert got[:4] == [0.049919, 0.049919, 0.049919, 0.049918]
    assert got[4] in (0.0, -0.0) and got[5] is None and got[6] != got[6] and got[7] == 38000.123457


def test_decode_without_else(spark):
    assert column(spark, [0, 7, None], X.decode("v", {0: "No"}), "v int") == ["No", None, None]


def test_null_safe_filters_keep_null_rows(spark):
    df = spark.createDataFrame([(11, "x"), (1, "Unknown/Invalid"), (None, None)], "c int, g string")
    assert {r["c"] for r in filters.exclude_codes(df, "c", [11, 13]).collect()} == {1, None}
    assert {r["g"] for r in filters.exclude_value(df, "g", "Unknown/Invalid").collect()} == {
        "x", None}


def test_null_tokens_match_exactly(spark):
    values = ["?", "None", "NULL", "", " ?", None]
    df = spark.createDataFrame([(i, v, v, i) for i, v in enumerate(values)],
                               "i int, a string, lab string, n int")
    out = filters.null_tokens(df, ["?"], per_column={"lab": ["?", "None"]}).orderBy("i").collect()
    assert [r["a"] for r in out] == [None, "None", "NULL", "", " ?", None]
    assert [r["lab"] for r in out] == [None, None, "NULL", "", " ?", None]
    assert out[0]["n"] == 0


def test_top_k_ties_and_null(spark):
    values = ["b"] * 3 + ["d"] * 2 + ["c"] * 2 + ["a"] + [None] * 9
    df = spark.createDataFrame([(v,) for v in values], "v string")
    out = filters.collapse_top_k(df, "v", 2, "rest").groupBy("v").count().collect()
    assert {r["v"]: r["count"] for r in out} == {"b": 3, "c": 2, "rest": 12}
    top = filters.top_values(df, "v", 2)
    assert filters.keep_members(df, "v", top).count() == 5
    assert filters.drop_members(df, "v", top).count() == 12


def test_slice_and_fixed_order(spark):
    df = spark.createDataFrame([("NO", 1), ("<30", 2), (">30", 3), ("<30", 4)], "r string, n int")
    assert filters.slice_by(df, r=["NO", "<30"], n=2).count() == 1
    order = filters.order_by_list(df, "r", ["NO", ">30", "<30"]).collect()
    assert [r["r"] for r in order] == ["NO", ">30", "<30", "<30"]


def test_hyphenated_columns_are_quoted(spark):
    df = spark.createDataFrame([("Up",)], ["glyburide-metformin"])
    assert df.select(F.col(X.quoted("glyburide-metformin"))).first()[0] == "Up"
    assert df.select(X.row_count_eq(["glyburide-metformin"], "Up")).first()[0] == 1
