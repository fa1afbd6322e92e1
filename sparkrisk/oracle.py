"""Plain SQL for every query that SQL can express, written for DuckDB.

Each statement starts from the given tables: ``raw`` derives the encounters, ``norm``
removes null tokens, ``enc`` is the clean table. Independent of the Spark operators:
history is a window over orders, quantiles are ``quantile_cont``, ranks are
``row_number`` over the whole table.
"""

from __future__ import annotations

import math

from sparkrisk.spec import (
    CLEAN_SCHEMA, EXPIRED_OR_HOSPICE_CODES, FEATURE_CATEGORICAL, FEATURE_NUMERIC,
    KEPT_MEDICATIONS, PROFILE_NUMERIC, RARE_MEDICATIONS, RULE_WEIGHTS,
)
from sparkrisk.sources.lookups import LOOKUPS
from sparkrisk.sources.star import DOSAGE_FACTORS


def _q(name: str) -> str:
    return f'"{name}"'


def _dose(factor: int) -> str:
    return f"(k * {factor} + c) % 20"


_KEPT = ",\n    ".join(
    f"CASE WHEN {_dose(p)} = 0 THEN 'Up' WHEN {_dose(p)} = 1 THEN 'Down' "
    f"WHEN {_dose(p)} <= 6 THEN 'Steady' ELSE 'No' END AS {_q(m)}"
    for m, p in zip(KEPT_MEDICATIONS, DOSAGE_FACTORS))
_RARE = ",\n    ".join(
    f"CASE WHEN k % 401 = {i} THEN 'Steady' ELSE 'No' END AS {_q(m)}"
    for i, m in enumerate(RARE_MEDICATIONS))
_CHANGED = " OR ".join(f"{_dose(p)} < 2" for p in DOSAGE_FACTORS[:4])


def _diag(name: str, modulus: int, rest: int, factor: int) -> str:
    return f"""CASE WHEN k % {modulus} = {rest} THEN '?'
         WHEN k % 11 = 0 THEN 'V' || (k % 90)
         WHEN k % 13 = 0 THEN 'E' || (800 + k % 190)
         WHEN k % 9 = 0 THEN '250.' || (k % 100)
         WHEN k % 17 = 0 THEN CAST(785 + k % 5 AS VARCHAR)
         ELSE CAST(139 + (k * {factor}) % 862 AS VARCHAR) END AS {name}"""


RAW = f"""
items AS (
  SELECT l_orderkey,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned,
         CAST(sum(l_quantity) AS BIGINT) AS quantity
  FROM lineitem GROUP BY l_orderkey),
visits AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS prio,
         date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS day
  FROM orders),
history AS (
  SELECT *,
         count(*) FILTER (WHERE prio = '2-HIGH') OVER y AS n_in,
         count(*) FILTER (WHERE prio = '1-URGENT') OVER y AS n_em,
         count(*) FILTER (WHERE prio NOT IN ('2-HIGH', '1-URGENT')) OVER y AS n_out,
         lead(day) OVER (PARTITION BY c ORDER BY day, k) - day AS gap
  FROM visits
  WINDOW y AS (PARTITION BY c ORDER BY day RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING)),
raw AS (
  SELECT k AS encounter_id, c AS patient_nbr,
    CASE WHEN c % 45 = 0 THEN '?' WHEN c % 9 < 6 THEN 'Caucasian'
         WHEN c % 9 < 8 THEN 'AfricanAmerican' ELSE 'Other' END AS race,
    CASE WHEN c % 500 = 499 THEN 'Unknown/Invalid' WHEN c % 2 = 0 THEN 'Female'
         ELSE 'Male' END AS gender,
    '[' || (((c * 7 + 3) % 10) * 10) || '-' || (((c * 7 + 3) % 10 + 1) * 10) || ')' AS age,
    CASE WHEN k % 31 = 0 THEN '[75-100)' ELSE '?' END AS weight,
    CAST(CASE prio WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3
         WHEN '4-NOT SPECIFIED' THEN 5 ELSE 6 END AS INT) AS admission_type_id,
    CAST(CASE WHEN k % 97 < 60 THEN 1 WHEN k % 97 < 75 THEN 3 WHEN k % 97 < 88 THEN 6
         WHEN k % 97 = 88 THEN 11 WHEN k % 97 = 89 THEN 13 WHEN k % 97 = 90 THEN 20
         WHEN k % 97 < 95 THEN 22 ELSE 18 END AS INT) AS discharge_disposition_id,
    CAST(c_nationkey % 25 + 1 AS INT) AS admission_source_id,
    CAST(1 + (k * 13) % 14 AS INT) AS time_in_hospital,
    CASE WHEN c % 5 < 2 THEN '?' WHEN c % 7 = 0 THEN 'MC' WHEN c % 7 = 1 THEN 'HM'
         WHEN c % 7 = 2 THEN 'SP' WHEN c % 7 = 3 THEN 'BC' WHEN c % 7 = 4 THEN 'MD'
         WHEN c % 7 = 5 THEN 'CP' ELSE 'UN' END AS payer_code,
    CASE WHEN k % 2 = 0 THEN '?'
         ELSE 'Specialty-' || CAST(floor(sqrt((k * 31) % 5329)) AS INT) END AS medical_specialty,
    CAST(1 + (k * 31) % 132 AS INT) AS num_lab_procedures,
    CAST(least(coalesce(returned, 0), 6) AS INT) AS num_procedures,
    CAST(coalesce(quantity, 0) % 81 + 1 AS INT) AS num_medications,
    CAST(n_out AS INT) AS number_outpatient, CAST(n_em AS INT) AS number_emergency,
    CAST(n_in AS INT) AS number_inpatient,
    {_diag("diag_1", 1999, 7, 37)},
    {_diag("diag_2", 281, 5, 53)},
    {_diag("diag_3", 71, 9, 71)},
    CAST(1 + (k * 5) % 9 AS INT) AS number_diagnoses,
    CASE k % 40 WHEN 0 THEN '>200' WHEN 1 THEN '>300' WHEN 2 THEN 'Norm' ELSE 'None' END
      AS max_glu_serum,
    CASE k % 12 WHEN 0 THEN '>7' WHEN 1 THEN '>8' WHEN 2 THEN 'Norm' ELSE 'None' END
      AS "A1Cresult",
    {_KEPT},
    {_RARE},
    CASE WHEN {_CHANGED} THEN 'Ch' ELSE 'No' END AS change,
    CASE WHEN k % 4 = 0 THEN 'No' ELSE 'Yes' END AS "diabetesMed",
    CASE WHEN gap IS NULL THEN 'NO' WHEN gap <= 30 THEN '<30' ELSE '>30' END AS readmitted
  FROM history JOIN customer ON c = c_custkey LEFT JOIN items ON k = l_orderkey)"""

_TEXT = ["race", "gender", "age", "weight", "payer_code", "medical_specialty",
         "diag_1", "diag_2", "diag_3", *KEPT_MEDICATIONS, *RARE_MEDICATIONS,
         "change", "diabetesMed", "readmitted"]
_NULLED = ", ".join(f"nullif({_q(c)}, '?') AS {_q(c)}" for c in _TEXT)
NORM = f"""
norm AS (
  SELECT * REPLACE ({_NULLED},
      CASE WHEN max_glu_serum NOT IN ('?', 'None') THEN max_glu_serum END AS max_glu_serum,
      CASE WHEN "A1Cresult" NOT IN ('?', 'None') THEN "A1Cresult" END AS "A1Cresult"),
    CAST(readmitted = '<30' AS INT) AS readmitted_30d
  FROM raw)"""

_LEAK = ", ".join(map(str, EXPIRED_OR_HOSPICE_CODES))


def _icd9(col: str) -> str:
    v = f"TRY_CAST({col} AS DOUBLE)"
    return f"""CASE WHEN {col} IS NULL THEN 'Missing'
      WHEN {col} LIKE 'V%' OR {col} LIKE 'E%' OR {v} IS NULL THEN 'Other'
      WHEN {v} BETWEEN 390 AND 459 OR {v} = 785 THEN 'Circulatory'
      WHEN {v} BETWEEN 460 AND 519 OR {v} = 786 THEN 'Respiratory'
      WHEN {v} BETWEEN 520 AND 579 OR {v} = 787 THEN 'Digestive'
      WHEN {v} BETWEEN 580 AND 629 OR {v} = 788 THEN 'Genitourinary'
      WHEN {v} >= 250 AND {v} < 251 THEN 'Diabetes'
      WHEN {v} BETWEEN 800 AND 999 THEN 'Injury'
      WHEN {v} BETWEEN 710 AND 739 THEN 'Musculoskeletal'
      WHEN {v} BETWEEN 140 AND 239 THEN 'Neoplasms' ELSE 'Other' END"""


def _level(col: str) -> str:
    return (f"CAST(CASE {col} WHEN 'No' THEN 0 WHEN 'Down' THEN 1 WHEN 'Steady' THEN 2 "
            f"WHEN 'Up' THEN 3 END AS INT)")


def _count_levels(value: str) -> str:
    return "CAST(" + " + ".join(
        f"CASE WHEN {_q(m)} = '{value}' THEN 1 ELSE 0 END" for m in KEPT_MEDICATIONS) + " AS INT)"


_AGE = ("(CAST(regexp_extract(age, '(\\d+)-', 1) AS INT)"
        " + CAST(regexp_extract(age, '-(\\d+)', 1) AS INT)) / 2.0")
_UTIL = "number_outpatient + number_emergency + number_inpatient"


def _top(table: str, col: str, k: int) -> str:
    return (f"(SELECT {col} FROM {table} WHERE {col} IS NOT NULL GROUP BY {col} "
            f"ORDER BY count(*) DESC, {col} LIMIT {k})")


_LEVELS = ", ".join(f"{_level(_q(m))} AS {_q(m)}" for m in KEPT_MEDICATIONS)
ENC = f"""
alive AS (
  SELECT * FROM norm WHERE discharge_disposition_id IS NULL
     OR discharge_disposition_id NOT IN ({_LEAK})),
enc AS (
  SELECT {", ".join(_q(f.name) for f in CLEAN_SCHEMA.fields)} FROM (
    SELECT * REPLACE (
        coalesce(race, 'Unknown') AS race,
        coalesce(max_glu_serum, 'Not Tested') AS max_glu_serum,
        coalesce("A1Cresult", 'Not Tested') AS "A1Cresult",
        CASE WHEN medical_specialty IN {_top("alive", "medical_specialty", 10)}
             THEN medical_specialty ELSE 'Other/Missing' END AS medical_specialty,
        CASE WHEN payer_code IN {_top("alive", "payer_code", 5)}
             THEN payer_code ELSE 'Other/Unknown' END AS payer_code,
        {_LEVELS},
        CAST(change = 'Ch' AS INT) AS change, CAST("diabetesMed" = 'Yes' AS INT) AS "diabetesMed"),
      {_icd9("diag_1")} AS diag_1_group, {_icd9("diag_2")} AS diag_2_group,
      {_icd9("diag_3")} AS diag_3_group,
      CAST({_AGE} AS DOUBLE) AS age_numeric,
      {_count_levels("Up")} AS num_med_increased, {_count_levels("Down")} AS num_med_decreased,
      CAST({_UTIL} AS INT) AS service_utilization,
      CAST(number_inpatient > 0 AS INT) AS had_prior_inpatient
    FROM alive WHERE diag_1 IS NOT NULL AND gender IS DISTINCT FROM 'Unknown/Invalid'))"""

_SCORE = " + ".join(f"{w} * {c}" for c, w in RULE_WEIGHTS.items())
RULED = f"""
ruled AS (SELECT *, {_SCORE} AS risk_score FROM enc),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, md5(CAST(encounter_id AS VARCHAR)),
                               encounter_id) AS r, count(*) OVER () AS n
  FROM ruled)"""


def _hash32(key: str, seed: int) -> str:
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 8) AS BIGINT)"


TESTED = f"""
tested AS (
  SELECT *, {_hash32("patient_nbr", 42)} < {int(0.2 * 2 ** 32)} AS is_test FROM ruled)"""

_QCUT = "greatest(1, (10 * (r - 1) + n - 2) // greatest(n - 1, 1))"
_NTILE = "ntile(10) OVER (ORDER BY r)"
DECILES = f"""
deciles AS (
  SELECT *, CAST({_QCUT} AS INT) AS qd, CAST({_NTILE} AS INT) AS nd FROM ordered)"""
BANDED = f"""
test_ranked AS (
  SELECT *, row_number() OVER (ORDER BY risk_score DESC, md5(CAST(encounter_id AS VARCHAR)),
                               encounter_id) AS r, count(*) OVER () AS n
  FROM tested WHERE is_test),
banded AS (
  SELECT t.*, CAST({_QCUT} AS INT) AS d,
    CASE WHEN {_QCUT} <= 2 THEN 'High Risk (Top 20%)' WHEN {_QCUT} <= 5
         THEN 'Medium Risk (Mid 30%)' ELSE 'Low Risk (Bottom 50%)' END AS band
  FROM test_ranked t)"""


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


_R, _N, _E = _with(RAW), _with(RAW, NORM), _with(RAW, NORM, ENC)
_S = _with(RAW, NORM, ENC, RULED)
_D = _with(RAW, NORM, ENC, RULED, DECILES)
_T = _with(RAW, NORM, ENC, RULED, TESTED)
_B = _with(RAW, NORM, ENC, RULED, TESTED, BANDED)


def _pct(num: str, den: str) -> str:
    return (f"CASE WHEN {den} > 0 THEN "
            f"((20000 * CAST({num} AS BIGINT) + {den}) // (2 * {den})) / 100.0::DOUBLE END")


def _mean1(col: str) -> str:
    return (f"((20 * CAST(sum({col}) AS BIGINT) + count({col})) // (2 * count({col})))"
            f" / 10.0::DOUBLE")


_SUM = "CAST(coalesce(sum(readmitted_30d), 0) AS BIGINT)"
_RATE = f"{_pct(_SUM, 'count(*)')} AS readmit_rate_pct"


def _tier(labels: tuple[str, str, str, str], col: str = "service_utilization") -> str:
    return (f"CASE WHEN {col} = 0 THEN '{labels[0]}' WHEN {col} IN (1, 2) THEN '{labels[1]}' "
            f"WHEN {col} IN (3, 4, 5) THEN '{labels[2]}' ELSE '{labels[3]}' END")


_LONG_TIERS = ("0 - No prior visits", "1-2 - Low utilization", "3-5 - Moderate utilization",
               "6+ - High utilization")
_SHORT_TIERS = ("No prior visits", "Low utilization", "Moderate utilization", "High utilization")


def _dim(name: str) -> str:
    rows = ", ".join("({}, '{}')".format(k, v.replace("'", "''")) for k, v in LOOKUPS[name].items())
    return f"dim(id, description) AS (VALUES {rows})"


def _by_dim(name: str, out: str, min_n: int, join: str = "JOIN") -> str:
    return f"""{_with(RAW, NORM, ENC, _dim(name))}
SELECT description AS {out}, count(*) AS n_encounters, {_RATE}
FROM enc {join} dim ON enc.{name}_id = dim.id GROUP BY 1 HAVING count(*) >= {min_n}"""


def _union(template: str, cols) -> str:
    return "\nUNION ALL\n".join(template.format(c=_q(c), name=c) for c in cols)


def _describe(prefix: str, table: str, cols) -> str:
    one = ("SELECT '{name}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean, "
           "round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min, "
           "round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 6) AS p25, "
           "round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 6) AS p50, "
           "round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 6) AS p75, "
           f"CAST(max({{c}}) AS DOUBLE) AS max FROM {table}")
    return f"{prefix}\n{_union(one, cols)}"


def _fences(table: str, cols) -> str:
    one = (f"SELECT '{{name}}' AS feature, quantile_cont(CAST({{c}} AS DOUBLE), 0.25) AS q1, "
           f"quantile_cont(CAST({{c}} AS DOUBLE), 0.5) AS q2, "
           f"quantile_cont(CAST({{c}} AS DOUBLE), 0.75) AS q3 FROM {table}")
    long = f"SELECT '{{name}}' AS feature, CAST({{c}} AS DOUBLE) AS v FROM {table}"
    return (f"f0 AS ({_union(one, cols)}), "
            "f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM f0), "
            f"v AS ({_union(long, cols)})")


def _outliers(prefix: str, table: str, cols) -> str:
    return f"""{prefix}{"," if prefix else "WITH"} {_fences(table, cols)}
SELECT feature, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
  round(any_value(lo), 6) AS lower_bound, round(any_value(hi), 6) AS upper_bound,
  count(*) FILTER (WHERE v < lo OR v > hi) AS n_outliers,
  {_pct("count(*) FILTER (WHERE v < lo OR v > hi)", "count(*)")} AS pct_outliers
FROM f JOIN v USING (feature) GROUP BY feature"""


def _histogram(prefix: str, table: str, cols, bins: int) -> str:
    long = f"SELECT '{{name}}' AS feature, CAST({{c}} AS DOUBLE) AS v FROM {table}"
    return f"""{prefix}{"," if prefix else "WITH"} v AS ({_union(long, cols)}),
ends AS (SELECT feature, min(v) AS lo, (max(v) - min(v)) / {bins} AS w FROM v GROUP BY feature),
placed AS (SELECT feature, lo, w, CASE WHEN w = 0 THEN 0 ELSE
    CAST(least(floor((v - lo) / w), {bins - 1}) AS INT) END AS bin
  FROM v JOIN ends USING (feature) WHERE v IS NOT NULL),
slots AS (SELECT feature, lo, w, unnest(range(CASE WHEN w = 0 THEN 1 ELSE {bins} END)) AS bin
  FROM ends WHERE lo IS NOT NULL)
SELECT slots.feature, CAST(slots.bin AS INT) AS bin,
  round(any_value(slots.lo + slots.bin * slots.w), 6) AS bin_start, count(placed.bin) AS n
FROM slots LEFT JOIN placed ON placed.feature = slots.feature AND placed.bin = slots.bin
GROUP BY slots.feature, slots.bin"""


def _corr(prefix: str, table: str, cols) -> str:
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    return prefix + "\n" + "\nUNION ALL\n".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round(corr({_q(a)}, {_q(b)}), 6) AS r "
        f"FROM {table}" for a, b in pairs)


def _auc(prefix: str, table: str, score: str, label: str) -> str:
    return f"""{prefix}{"," if prefix else "WITH"} h AS (
  SELECT {score} AS s, CAST(sum({label}) AS DOUBLE) AS p,
         CAST(count(*) - sum({label}) AS DOUBLE) AS q FROM {table} GROUP BY 1),
c AS (SELECT *, sum(q) OVER (ORDER BY s) - q AS below FROM h)
SELECT round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6) AS roc_auc FROM c"""


def _roc(prefix: str, table: str, score: str, label: str, points: int | None) -> str:
    piece = "cm" if points is None else f"(cm * {points} + am - 1) // am"
    return f"""{prefix}{"," if prefix else "WITH"} h AS (
  SELECT {score} AS s, CAST(sum({label}) AS BIGINT) AS p, count(*) AS m FROM {table} GROUP BY 1),
c AS (SELECT s, CAST(sum(p) OVER w AS BIGINT) AS cp, CAST(sum(m) OVER w AS BIGINT) AS cm,
        CAST(sum(p) OVER () AS BIGINT) AS ap, CAST(sum(m) OVER () AS BIGINT) AS am
      FROM h WINDOW w AS (ORDER BY s DESC)),
g AS (SELECT *, CAST({piece} AS BIGINT) AS point FROM c)
SELECT CAST(0 AS BIGINT) AS point, CAST(NULL AS DOUBLE) AS threshold, CAST(0 AS DOUBLE) AS fpr,
  CAST(0 AS DOUBLE) AS tpr
UNION ALL
SELECT point, CAST(arg_max(s, cm) AS DOUBLE) AS threshold,
  round((max(cm) - arg_max(cp, cm)) / CAST(any_value(am - ap) AS DOUBLE), 6) AS fpr,
  round(arg_max(cp, cm) / CAST(any_value(ap) AS DOUBLE), 6) AS tpr
FROM g GROUP BY point"""


_GAPPY = """WITH gappy AS (
  SELECT event_id AS id, CASE WHEN event_id % 7 IN (0, 3) THEN NULL ELSE value END AS gaps,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 20 END AS code,
    CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'w' || CAST(event_id % 9 AS VARCHAR) END AS word
  FROM events)"""


_PURCHASES = """WITH bought AS (
  SELECT event_id, value, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS bought
  FROM events)"""


def _lift(table: str, top: str) -> str:
    top_pos = f"sum(readmitted_30d) FILTER (WHERE {top})"
    return f"""SELECT
  {_pct(f"coalesce({top_pos}, 0)", f"count(*) FILTER (WHERE {top})")} AS top_decile_readmit_rate_pct,
  {_pct(f"coalesce({top_pos}, 0)", _SUM)} AS pct_of_readmissions_captured,
  round((CAST({top_pos} AS DOUBLE) / count(*) FILTER (WHERE {top}))
        / (CAST(sum(readmitted_30d) AS DOUBLE) / count(*)), 6) AS lift_vs_random
FROM {table}"""


def _compared(prefix: str, rows: str, by: str) -> str:
    """Measures of a classifier per group of rows (by, id, y, s, flagged)."""
    first = f"{_QCUT} = 1"
    return f"""{prefix}{"," if prefix else "WITH"} rows_of AS ({rows}),
o AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY s DESC, md5(CAST(id AS VARCHAR)), id) AS r,
        count(*) OVER (PARTITION BY g) AS n FROM rows_of),
m AS (SELECT g, count(*) FILTER (WHERE y = 1 AND flagged) AS tp, count(*) FILTER (WHERE y = 0 AND flagged) AS fp,
        count(*) FILTER (WHERE y = 0 AND NOT flagged) AS tn, count(*) FILTER (WHERE y = 1 AND NOT flagged) AS fn,
        CAST(sum(y) AS BIGINT) AS pos, count(*) AS al, count(*) FILTER (WHERE {first}) AS tops,
        CAST(coalesce(sum(y) FILTER (WHERE {first}), 0) AS BIGINT) AS top_pos FROM o GROUP BY g),
h AS (SELECT g, s, CAST(sum(y) AS DOUBLE) AS p, CAST(count(*) - sum(y) AS DOUBLE) AS q FROM rows_of GROUP BY g, s),
c AS (SELECT *, sum(q) OVER (PARTITION BY g ORDER BY s) - q AS below FROM h),
a AS (SELECT g, round(sum(p * (below + q / 2.0)) / (sum(p) * sum(q)), 6) AS roc_auc FROM c GROUP BY g)
SELECT m.g AS {by}, round((tp + tn) / CAST(al AS DOUBLE), 6) AS accuracy,
  round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision,
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1, roc_auc,
  {_pct("top_pos", "tops")} AS top_decile_readmit_rate_pct, {_pct("top_pos", "pos")} AS pct_of_readmissions_captured,
  round((CAST(top_pos AS DOUBLE) / tops) / (CAST(pos AS DOUBLE) / al), 6) AS lift_vs_random
FROM m JOIN a ON m.g = a.g"""


#: a small tree, leaf by leaf: value, then (column, condition, share) along its path
_TREE = [
    (0.1, [("number_inpatient", "<= 1", 0.8), ("time_in_hospital", "<= 5", 0.4)]),
    (0.2, [("number_inpatient", "<= 1", 0.8), ("time_in_hospital", "> 5", 0.6)]),
    (0.3, [("number_inpatient", "> 1", 0.2), ("num_medications", "<= 40", 0.5)]),
    (0.6, [("number_inpatient", "> 1", 0.2), ("num_medications", "> 40", 0.5)]),
    (0.05, [("time_in_hospital", "> 9", 0.3)]),
]


def _tree_value(col: str) -> str:
    """Shapley value of a column: both orders of two features, each half the time."""
    terms = []
    for value, path in _TREE:
        for c, test, share in path:
            if c == col:
                others = [(d, u, s) for d, u, s in path if d != c]
                rest = f"(({others[0][0]} {others[0][1]})::INT + {others[0][2]}) / 2" if others else "1"
                terms.append(f"{value} * (({c} {test})::INT - {share}) * {rest}")
    return "CAST(" + " + ".join(terms) + " AS DOUBLE)"


def _tree_margin() -> str:
    return "CAST(" + " + ".join(
        f"{v} * " + " * ".join(f"({c} {test})::INT" for c, test, _ in path) for v, path in _TREE) + " AS DOUBLE)"


def _tree_base() -> float:
    return round(sum(v * math.prod(s for *_, s in path) for v, path in _TREE), 6)


_TREE_COLUMNS = ["number_inpatient", "time_in_hospital", "num_medications"]
_TREE_LONG = "\n  UNION ALL ".join(
    f"SELECT encounter_id, '{c}' AS feature, {_tree_value(c)} AS shap FROM enc" for c in _TREE_COLUMNS)


_TWO_SCORES = """
  SELECT 'rule' AS g, encounter_id AS id, readmitted_30d AS y, risk_score AS s, risk_score >= 12 AS flagged FROM ruled
  UNION ALL
  SELECT 'visits', encounter_id, readmitted_30d, service_utilization, service_utilization >= 3 FROM ruled"""


def _gains(prefix: str, table: str, decile: str, label: str) -> str:
    s = f"CAST(sum({label}) AS BIGINT)"
    return f"""{prefix}
SELECT {decile} AS risk_decile, count(*) AS n_encounters, {s} AS n_readmissions,
  {_pct(s, "count(*)")} AS readmit_rate_pct,
  {_pct(s, f"(SELECT CAST(sum({label}) AS BIGINT) FROM {table})")}
    AS pct_of_all_readmissions_captured
FROM {table} GROUP BY 1"""


_KPIS = """SELECT count(*) AS total_encounters,
  CAST(coalesce(sum(readmitted_30d), 0) AS BIGINT) AS total_readmissions,
  round(CASE WHEN count(*) = 0 THEN 0.0 ELSE sum(readmitted_30d) / CAST(count(*) AS DOUBLE) END, 6)
    AS readmission_rate,
  round(coalesce(avg(time_in_hospital), 0.0), 6) AS avg_length_of_stay"""

_AUDIT = f"""{_N}, marked AS (
  SELECT readmitted_30d AS y,
    CASE WHEN discharge_disposition_id IN ({_LEAK}) THEN 1 WHEN diag_1 IS NULL THEN 2
         WHEN gender = 'Unknown/Invalid' THEN 3 ELSE 4 END AS gone FROM norm),
steps AS (SELECT * FROM (VALUES (1, 'leakage'), (2, 'missing_primary_diagnosis'),
                                (3, 'invalid_gender')) t(step_no, step)),
counted AS (
  SELECT step_no, step, count(*) FILTER (WHERE gone >= step_no) AS rows_in,
    count(*) FILTER (WHERE gone = step_no) AS rows_removed,
    count(*) FILTER (WHERE gone > step_no) AS rows_left,
    CAST(sum(y) FILTER (WHERE gone > step_no) AS BIGINT) AS pos
  FROM steps, marked GROUP BY step_no, step)
SELECT CAST(step_no AS INT) AS step_no, step, rows_in, rows_removed, rows_left,
  {_pct("rows_removed", "rows_in")} AS removed_pct,
  {_pct("pos", "rows_left")} AS label_rate_pct FROM counted"""

_SPLIT = ("CASE WHEN is_test THEN 'test' ELSE 'train' END AS data_split, "
          "is_test AS is_out_of_sample_prediction")


def _exact(table: str, prefix: str, key: str, id: str, share: float, seed: int, more: str) -> str:
    return f"""{prefix}{"," if prefix else "WITH"} keys AS (
  SELECT {key} AS k, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS r,
         count(*) OVER () AS n FROM (SELECT DISTINCT {key} FROM {table})),
t AS (SELECT {table}.*, r <= ceil({share} * n) AS is_test FROM {table} JOIN keys ON {key} = k)
SELECT {more}, {_SPLIT} FROM t"""


_VALUES = _union("SELECT '{name}' AS f, CAST({c} AS VARCHAR) AS v FROM enc", FEATURE_CATEGORICAL)
_NAMED = f"named AS (SELECT f || '_' || v AS name, count(*) AS n FROM ({_VALUES}) GROUP BY f, v)"
_NUMERIC_LIST = ", ".join(f"('{c}')" for c in FEATURE_NUMERIC)
_ALL_RAW = ["encounter_id", "patient_nbr", "admission_type_id", "discharge_disposition_id",
            "admission_source_id", *PROFILE_NUMERIC, *_TEXT, "max_glu_serum", "A1Cresult"]
_PRICES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# Whole hundredths: their sums are exact, so the mean does not depend on the order of rows.
_CENTS = "WITH cents AS (SELECT " + ", ".join(
    f"CAST(round({c} * 100) AS BIGINT) AS {c}" for c in _PRICES) + " FROM lineitem)"

ORACLE: dict[str, str] = {
    "null_tokens": f"""{_N} SELECT encounter_id, race, weight, payer_code, medical_specialty,
  diag_1, diag_2, diag_3, max_glu_serum, "A1Cresult" FROM norm""",
    "exclude_leakage": f"""{_R} SELECT encounter_id, discharge_disposition_id FROM raw
WHERE discharge_disposition_id NOT IN ({_LEAK})""",
    "exclude_invalid_gender": f"""{_R} SELECT encounter_id, gender FROM raw
WHERE gender IS DISTINCT FROM 'Unknown/Invalid'""",
    "primary_diagnosis_known": f"""{_N} SELECT encounter_id, {_icd9("diag_1")} AS diag_1_group
FROM norm WHERE diag_1 IS NOT NULL""",
    "binary_label_of_class": f"""{_R} SELECT encounter_id,
  CAST(coalesce(readmitted = '<30', false) AS INT) AS readmitted_30d FROM raw""",
    "fill_categories": f"""{_N} SELECT encounter_id, coalesce(race, 'Unknown') AS race,
  coalesce("A1Cresult", 'Not Tested') AS "A1Cresult",
  coalesce(max_glu_serum, 'Not Tested') AS max_glu_serum FROM norm""",
    "collapse_top_k": f"""{_N} SELECT encounter_id,
  CASE WHEN medical_specialty IN {_top("norm", "medical_specialty", 10)} THEN medical_specialty
       ELSE 'Other/Missing' END AS medical_specialty,
  CASE WHEN payer_code IN {_top("norm", "payer_code", 5)} THEN payer_code
       ELSE 'Other/Unknown' END AS payer_code FROM norm""",
    "collapse_document_sources": f"""SELECT doc_id,
  CASE WHEN source IN {_top("documents", "source", 3)} THEN source ELSE 'other' END AS source
FROM documents""",
    "keep_top_specialties": f"""{_N} SELECT encounter_id, medical_specialty FROM norm
WHERE medical_specialty IN {_top("norm", "medical_specialty", 10)}""",
    "icd9_groups": f"""{_N} SELECT encounter_id, {_icd9("diag_1")} AS diag_1_group,
  {_icd9("diag_2")} AS diag_2_group, {_icd9("diag_3")} AS diag_3_group FROM norm""",
    "age_midpoint": f"""{_R} SELECT encounter_id, age,
  CAST(regexp_extract(age, '(\\d+)-', 1) AS INT) AS age_lower,
  CAST({_AGE} AS DOUBLE) AS age_numeric FROM raw""",
    "ordinal_medications": f"{_R} SELECT encounter_id, {_LEVELS} FROM raw",
    "medication_counts": f"""{_R} SELECT encounter_id, {_count_levels("Up")} AS num_med_increased,
  {_count_levels("Down")} AS num_med_decreased, CAST(change = 'Ch' AS INT) AS change,
  CAST("diabetesMed" = 'Yes' AS INT) AS "diabetesMed" FROM raw""",
    "utilization": f"""{_R} SELECT encounter_id, CAST({_UTIL} AS INT) AS service_utilization,
  CAST(number_inpatient > 0 AS INT) AS had_prior_inpatient,
  CAST(least(number_inpatient, 5) AS INT) AS number_inpatient_capped,
  CAST(number_inpatient >= 3 AS INT) AS triage_flag,
  {_tier(_LONG_TIERS, f"({_UTIL})")} AS utilization_tier FROM raw""",
    "clean_full": f"{_E} SELECT * FROM enc",
    "audit_of_cleaning": _AUDIT,
    "total_nulls": f"{_E} SELECT CAST(" + " + ".join(
        f"count(*) FILTER (WHERE {_q(f.name)} IS NULL)" for f in CLEAN_SCHEMA.fields)
        + " AS BIGINT) AS total_nulls FROM enc",

    "overall_rate": f"""{_E} SELECT count(*) AS total_encounters, {_SUM} AS total_readmissions,
  {_RATE} FROM enc""",
    "rate_by_diagnosis": f"""{_E} SELECT diag_1_group, count(*) AS n_encounters,
  {_SUM} AS n_readmissions, {_RATE},
  {_pct("count(*)", "(SELECT count(*) FROM enc)")} AS pct_of_all_encounters
FROM enc GROUP BY diag_1_group""",
    "specialty_volume": f"""{_E} SELECT medical_specialty, count(*) AS n_encounters, {_RATE}
FROM enc GROUP BY 1 HAVING count(*) >= 185""",
    "utilization_tiers": f"""{_E} SELECT {_tier(_LONG_TIERS)} AS utilization_tier,
  count(*) AS n_encounters, {_SUM} AS n_readmissions, {_RATE} FROM enc GROUP BY 1""",
    "length_of_stay": f"""{_E} SELECT time_in_hospital AS length_of_stay_days,
  count(*) AS n_encounters, {_RATE}, {_mean1("num_medications")} AS avg_medications,
  {_mean1("num_procedures")} AS avg_procedures FROM enc GROUP BY 1""",
    "admission_type_join": _by_dim("admission_type", "admission_type", 200),
    "admission_source_join": _by_dim("admission_source", "admission_source", 590),
    "discharge_left_join": _by_dim("discharge_disposition", "discharge_disposition", 0,
                                   "LEFT JOIN"),
    "source_left_join": _by_dim("admission_source", "admission_source", 0, "LEFT JOIN"),
    "segment_matrix": f"""{_E} SELECT diag_1_group, {_tier(_SHORT_TIERS)} AS utilization_tier,
  count(*) AS n_encounters, {_RATE} FROM enc GROUP BY 1, 2 HAVING count(*) >= 300
ORDER BY readmit_rate_pct DESC, 1, 2 LIMIT 10""",
    "medication_change": f"""{_E} SELECT
  CASE change WHEN 1 THEN 'Medication changed' ELSE 'No change' END AS med_change_status,
  count(*) AS n_encounters, {_RATE} FROM enc GROUP BY 1""",
    "insulin_status": f"""{_E} SELECT ['No', 'Down', 'Steady', 'Up'][insulin + 1] AS insulin_status,
  count(*) AS n_encounters, {_RATE} FROM enc GROUP BY insulin""",
    "rate_by_age_band": f"""{_N} SELECT age, count(*) AS n_encounters, {_RATE} FROM norm
WHERE age IS NOT NULL GROUP BY age""",
    "rate_by_lab_keep_null": f"""{_N} SELECT "A1Cresult", count(*) AS n_encounters, {_RATE}
FROM norm GROUP BY 1""",
    "rate_by_lab_drop_null": f"""{_N} SELECT "A1Cresult", count(*) AS n_encounters, {_RATE}
FROM norm WHERE "A1Cresult" IS NOT NULL GROUP BY 1""",
    "rate_by_prior_inpatient": f"""{_E} SELECT had_prior_inpatient, count(*) AS n_encounters,
  {_SUM} AS n_readmissions, {_RATE} FROM enc GROUP BY 1""",
    "rate_at_eight_visits": f"""{_E} SELECT CAST(service_utilization >= 8 AS INT) AS eight_or_more,
  count(*) AS n_encounters, {_SUM} AS n_readmissions, {_RATE} FROM enc GROUP BY 1""",
    "capped_rates": _N + "\n" + _union(
        "SELECT '{name}' AS feature, CAST(least({c}, 5) AS INT) AS capped, "
        "count(*) AS n_encounters, " + _RATE.replace("{", "{{").replace("}", "}}")
        + " FROM norm GROUP BY 2",
        ("number_outpatient", "number_emergency", "number_inpatient")),
    "leakage_check": f"""{_N} SELECT
  count(*) FILTER (WHERE discharge_disposition_id IN ({_LEAK})) AS n_masked,
  {_pct(f"count(*) FILTER (WHERE discharge_disposition_id IN ({_LEAK}))", "count(*)")}
    AS pct_of_total,
  {_pct(f"coalesce(sum(readmitted_30d) FILTER (WHERE discharge_disposition_id IN ({_LEAK})), 0)",
        f"count(*) FILTER (WHERE discharge_disposition_id IN ({_LEAK}))")} AS label_rate_pct
FROM norm""",
    "kpis": f"{_E} {_KPIS} FROM enc",
    "kpis_of_slice": f"""{_E} {_KPIS} FROM enc WHERE gender = 'Female'
  AND diag_1_group IN ('Circulatory', 'Respiratory') AND admission_type_id = 1""",
    "label_distribution": f"""{_R} SELECT readmitted, count(*) AS n,
  {_pct("count(*)", "(SELECT count(*) FROM raw)")} AS pct FROM raw GROUP BY readmitted""",
    "class_balance": f"""{_E} SELECT {_SUM} AS n_positive, count(*) - {_SUM} AS n_negative,
  round((count(*) - {_SUM}) / CAST({_SUM} AS DOUBLE), 6) AS positive_weight FROM enc""",
    "quality_by_source": f"""WITH d AS (
  SELECT source, quality AS readmitted_30d FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n_encounters, {_SUM} AS n_readmissions, {_RATE},
  {_pct("count(*)", "(SELECT count(*) FROM d)")} AS pct_of_all_encounters FROM d GROUP BY source""",

    "ntile_gains": _gains(_D, "deciles", "nd", "readmitted_30d"),
    "cumulative_gains": f"""{_D}, g AS (
  SELECT nd, count(*) AS n, sum(readmitted_30d) AS p FROM deciles GROUP BY nd),
c AS (SELECT nd, CAST(sum(n) OVER (ORDER BY nd) AS BIGINT) AS cn,
             CAST(sum(p) OVER (ORDER BY nd) AS BIGINT) AS cp,
             CAST(sum(p) OVER () AS BIGINT) AS ap FROM g)
SELECT nd AS risk_decile, cn AS cum_encounters, cp AS cum_readmissions,
  {_pct("cp", "ap")} AS cum_pct_captured FROM c""",
    "ntile_deciles": f"{_D} SELECT encounter_id, risk_score, nd AS risk_decile FROM deciles",
    "qcut_deciles": f"{_D} SELECT encounter_id, risk_score, qd AS risk_decile FROM deciles",
    "global_rank": f"{_S} SELECT encounter_id, risk_score, r AS rank FROM ordered",
    "order_price_rank": """SELECT o_orderkey, o_totalprice, row_number() OVER (
  ORDER BY o_totalprice DESC, md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rank FROM orders""",
    "qcut_lift": f"{_D} {_lift('deciles', 'qd = 1')}",
    "triage_rule_lift": f"{_E} {_lift('enc', 'number_inpatient >= 3')}",
    "lift_measures": f"""{_D} SELECT
  round((sum(readmitted_30d) FILTER (WHERE qd = 1) / CAST(count(*) FILTER (WHERE qd = 1) AS DOUBLE))
        / (sum(readmitted_30d) / CAST(count(*) AS DOUBLE)), 6) AS top_decile_lift,
  round(sum(readmitted_30d) FILTER (WHERE qd <= 2) / CAST(sum(readmitted_30d) AS DOUBLE), 6)
    AS captured_top_two FROM deciles""",
    "risk_bands": f"""{_B} SELECT t.encounter_id,
  CASE WHEN t.is_test THEN 'test' ELSE 'train' END AS data_split,
  t.is_test AS is_out_of_sample_prediction, d AS predicted_risk_decile, band AS risk_band
FROM tested t LEFT JOIN banded b ON t.encounter_id = b.encounter_id""",
    "band_rates": f"""{_B} SELECT band AS risk_band, count(*) AS n_encounters,
  {_SUM} AS n_readmissions, {_RATE} FROM banded GROUP BY band""",
    "rule_worklist": f"""{_T} SELECT
  CAST(row_number() OVER (ORDER BY risk_score DESC, encounter_id) AS INT) AS priority_rank,
  encounter_id, patient_nbr, risk_score, diag_1_group, age_numeric, number_inpatient,
  service_utilization, time_in_hospital, discharge_disposition_id, medical_specialty,
  readmitted_30d FROM tested WHERE is_test ORDER BY risk_score DESC, encounter_id LIMIT 200""",
    "score_extremes": f"""{_S} SELECT CAST(min(risk_score) AS DOUBLE) AS min_score,
  round(avg(risk_score), 6) AS avg_score, CAST(max(risk_score) AS DOUBLE) AS max_score,
  (SELECT encounter_id FROM ruled ORDER BY risk_score, encounter_id LIMIT 1) AS lowest_id,
  (SELECT encounter_id FROM ruled ORDER BY risk_score DESC, encounter_id LIMIT 1) AS highest_id
FROM ruled""",
    "sample_n": f"""{_T} SELECT encounter_id, risk_score FROM tested WHERE is_test
ORDER BY md5('42:' || encounter_id), encounter_id LIMIT 2000""",

    "null_report": f"""{_N}, m AS ({_union(
        "SELECT '{name}' AS feature, count(*) - count({c}) AS missing_count, count(*) AS n "
        "FROM norm", _ALL_RAW)})
SELECT feature, missing_count, {_pct("missing_count", "n")} AS missing_pct FROM m
WHERE missing_count > 0""",
    "describe_numeric": _describe(_R, "raw", PROFILE_NUMERIC),
    "iqr_outliers": _outliers(_R, "raw", PROFILE_NUMERIC),
    "box_stats": f"""{_R}, {_fences("raw", PROFILE_NUMERIC)}
SELECT feature, round(any_value(q1), 6) AS q1, round(any_value(q2), 6) AS median,
  round(any_value(q3), 6) AS q3, min(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_low,
  max(v) FILTER (WHERE v BETWEEN lo AND hi) AS whisker_high,
  count(*) FILTER (WHERE v NOT BETWEEN lo AND hi) AS n_outliers
FROM f JOIN v USING (feature) GROUP BY feature""",
    "histogram": _histogram(_R, "raw", PROFILE_NUMERIC, 30),
    "corr_matrix": _corr(_N, "norm", [*PROFILE_NUMERIC, "readmitted_30d"]),
    "corr_with_label": f"{_N}\n" + _union(
        "SELECT '{name}' AS feature, round(corr({c}, readmitted_30d), 6) AS r FROM norm",
        PROFILE_NUMERIC),
    "cardinality": f"{_N}\n" + _union(
        "SELECT '{name}' AS feature, count(DISTINCT {c}) AS n_distinct FROM norm",
        ["patient_nbr", "diag_1", "diag_2", "diag_3"]),
    "category_counts": f"{_E}, {_NAMED} SELECT name, n FROM named",
    "near_zero_variance": f"""{_N}, v AS ({_union(
        "SELECT '{name}' AS feature, {c} AS v FROM norm", [*KEPT_MEDICATIONS, *RARE_MEDICATIONS])}),
c AS (SELECT feature, v, count(*) AS n FROM v WHERE v IS NOT NULL GROUP BY feature, v)
SELECT feature, round(max(n) / CAST((SELECT count(*) FROM norm) AS DOUBLE), 6) AS top_share
FROM c GROUP BY feature HAVING max(n) / CAST((SELECT count(*) FROM norm) AS DOUBLE) > 0.995""",
    "describe_lineitem": _describe(_CENTS, "cents", _PRICES),
    "iqr_lineitem": _outliers("", "lineitem", _PRICES),
    "histogram_lineitem": _histogram("", "lineitem", ["l_quantity"], 10),
    "corr_lineitem": _corr("", "lineitem", _PRICES),
    "describe_documents": _describe("", "documents", ["n_chars"]),

    "group_split_hash": f"{_T} SELECT encounter_id, patient_nbr, {_SPLIT} FROM tested",
    "group_split_exact": _exact("enc", _E, "patient_nbr", "encounter_id", 0.2, 42,
                                "encounter_id, patient_nbr"),
    "split_overlap": f"""{_T}, g AS (
  SELECT patient_nbr, count(DISTINCT is_test) AS sides FROM tested GROUP BY patient_nbr)
SELECT count(*) AS n_groups, count(*) FILTER (WHERE sides > 1) AS n_in_both FROM g""",
    "event_user_split": _exact("events", "", "user_id", "event_id", 0.3, 7, "event_id, user_id"),
    "class_weights": f"""{_E}, t AS (SELECT count(*) AS n, sum(readmitted_30d) AS p FROM enc)
SELECT encounter_id, round(CASE readmitted_30d WHEN 1 THEN n / (2.0::DOUBLE * p)
  ELSE n / (2.0::DOUBLE * (n - p)) END, 6) AS class_weight FROM enc, t""",
    "binary_metrics": f"""{_S}, m AS (SELECT
  count(*) FILTER (WHERE readmitted_30d = 1 AND risk_score >= 12) AS tp,
  count(*) FILTER (WHERE readmitted_30d = 0 AND risk_score >= 12) AS fp,
  count(*) FILTER (WHERE readmitted_30d = 0 AND risk_score < 12) AS tn,
  count(*) FILTER (WHERE readmitted_30d = 1 AND risk_score < 12) AS fn FROM ruled)
SELECT tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy,
  round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 6) AS precision,
  round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 6) AS recall,
  round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 6) AS f1 FROM m""",
    "roc_auc": _auc(_S, "ruled", "risk_score", "readmitted_30d"),
    "fixed_tree_attribution": f"""{_E} SELECT encounter_id, CAST({_tree_base()} AS DOUBLE) AS base,
  round({_tree_margin()}, 6) AS margin, {", ".join(f"round({_tree_value(c)}, 6) AS {c}" for c in _TREE_COLUMNS)} FROM enc""",
    "fixed_tree_importance": f"""{_E}, l AS ({_TREE_LONG}),
g AS (SELECT feature, round(avg(abs(shap)), 6) AS mean_abs_shap FROM l
      WHERE feature <> 'num_medications' GROUP BY feature)
SELECT CAST(row_number() OVER (ORDER BY mean_abs_shap DESC, feature) AS INT) AS place, * FROM g""",
    "fixed_tree_local": f"""{_E}, l AS ({_TREE_LONG}),
g AS (SELECT encounter_id, feature, round(shap, 6) AS shap FROM l
      WHERE encounter_id = (SELECT min(encounter_id) FROM enc)),
p AS (SELECT CAST(row_number() OVER (ORDER BY abs(shap) DESC, feature) AS INT) AS place, * FROM g)
SELECT * FROM p WHERE place <= 2""",
    "scores_compared": _compared(_S, _TWO_SCORES, "score"),
    "scores_lift": f"""SELECT score, top_decile_readmit_rate_pct, pct_of_readmissions_captured,
  lift_vs_random FROM ({_compared(_S, _TWO_SCORES, "score")})""",
    "event_types_compared": _compared("", """
  SELECT event_type AS g, event_id AS id, CAST(event_id % 2 AS INT) AS y, value AS s,
    value >= 50 AS flagged FROM events""", "event_type"),
    "roc_curve": _roc(_S, "ruled", "risk_score", "readmitted_30d", 100),
    "events_roc_full": _roc(_PURCHASES, "bought", "value", "bought", None),
    "gappy_histogram": _histogram(_GAPPY, "gappy", ["gaps"], 12),
    "gappy_outliers": _outliers(_GAPPY, "gappy", ["gaps"]),
    "gappy_extremes": f"""{_GAPPY} SELECT min(gaps) AS min_score, round(avg(gaps), 6) AS avg_score,
  max(gaps) AS max_score, arg_min(id, (gaps, id)) FILTER (WHERE gaps IS NOT NULL) AS lowest_id,
  arg_min(id, (-gaps, id)) FILTER (WHERE gaps IS NOT NULL) AS highest_id FROM gappy""",
    "gappy_codes": f"""{_GAPPY} SELECT id, code FROM gappy
WHERE code IS NULL OR code NOT IN (11, 13)""",
    "gappy_values": f"""{_GAPPY} SELECT id, word FROM gappy WHERE word IS NULL OR word <> 'w3'""",
    "events_roc_auc": _auc(_PURCHASES, "bought", "value", "bought"),
    "events_roc_curve": _roc(_PURCHASES, "bought", "value", "bought", 50),
    "events_gains": _gains(f"""{_PURCHASES}, o AS (
  SELECT *, row_number() OVER (ORDER BY value DESC, md5(CAST(event_id AS VARCHAR)), event_id) AS r,
    count(*) OVER () AS n FROM bought),
x AS (SELECT *, CAST({_QCUT} AS INT) AS d FROM o)""", "x", "d", "bought"),
    "reliable_features": f"""{_E}, {_NAMED}
SELECT * FROM (VALUES {_NUMERIC_LIST}) t(feature)
UNION ALL SELECT name FROM named WHERE n >= 200""",
    "unreliable_features": f"{_E}, {_NAMED} SELECT name AS feature FROM named WHERE n < 200",
    "rule_attribution": f"""{_E}, m AS (SELECT {", ".join(
        f"avg({c}) AS m_{c}" for c in RULE_WEIGHTS)} FROM enc)
""" + "\nUNION ALL\n".join(
        f"SELECT '{c}' AS feature, round(avg(abs({w} * ({c} - m_{c}))), 6) AS mean_abs_shap "
        f"FROM enc, m" for c, w in RULE_WEIGHTS.items()),
}

# fitted models: split, decile rule and identities decide these, not the scores
_SPLIT_EXACT = f"""{_E}, keys AS (
  SELECT patient_nbr AS k, row_number() OVER (ORDER BY md5('42:' || patient_nbr), patient_nbr) AS r,
         count(*) OVER () AS n FROM (SELECT DISTINCT patient_nbr FROM enc)),
t AS (SELECT r <= ceil(0.2 * n) AS is_test FROM enc JOIN keys ON patient_nbr = k),
tests AS (SELECT count(*) AS n FROM t WHERE is_test)"""
ORACLE |= {
    "scored_sizes": f"""{_SPLIT_EXACT},
places AS (SELECT unnest(range(1, n + 1)) AS r, n FROM tests),
tiles AS (SELECT CAST(greatest(1, (10 * (r - 1) + n - 2) // greatest(n - 1, 1)) AS INT) AS d
          FROM places)
SELECT 'test' AS data_split, d AS predicted_risk_decile,
  CASE WHEN d <= 2 THEN 'High Risk (Top 20%)' WHEN d <= 5 THEN 'Medium Risk (Mid 30%)'
       ELSE 'Low Risk (Bottom 50%)' END AS risk_band, count(*) AS n FROM tiles GROUP BY d
UNION ALL SELECT 'train', NULL, NULL, count(*) FROM t WHERE NOT is_test""",
    "model_auc_mirrored": "SELECT CAST(1.0 AS DOUBLE) AS both",
    "model_reloaded": f"""{_E} SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_unmatched,
  CAST(0.0 AS DOUBLE) AS max_diff FROM enc""",
    "shap_adds_up": f"{_SPLIT_EXACT} SELECT n, CAST(0 AS BIGINT) AS n_off FROM tests",
}

def _placed(select: str, order: str) -> str:
    """Rows of a select over the clean table with their place in an order."""
    return f"""{_E}, rows_of AS ({select})
SELECT CAST(row_number() OVER (ORDER BY {order}) AS INT) AS place, * EXCLUDE (hidden) FROM rows_of"""


_AGES = "count(*) AS n, CASE age WHEN '[70-80)' THEN 1 WHEN '[60-70)' THEN 2 WHEN '[80-90)' THEN 3 ELSE 4 END"
ORACLE |= {
    "ordered_by_count": _placed("""SELECT age_numeric, count(*) AS n_encounters, 0 AS hidden
FROM enc GROUP BY age_numeric""", "n_encounters DESC, age_numeric"),
    "ordered_by_hidden_sum": _placed("""SELECT diag_1_group, count(*) AS n_encounters,
sum(num_medications) AS hidden FROM enc GROUP BY diag_1_group""", "hidden DESC, diag_1_group"),
    "ordered_by_case": _placed("""SELECT gender, count(*) AS n_encounters,
CASE gender WHEN 'Female' THEN 9 WHEN 'Male' THEN 2 ELSE 3 END AS hidden FROM enc GROUP BY gender""",
                               "hidden, gender"),
    "ordered_utilization_tiers": f"""WITH t AS ({ORACLE["utilization_tiers"]})
SELECT CAST(row_number() OVER (ORDER BY utilization_tier) AS INT) AS place, * FROM t""",
    "ordered_medication_change": f"""WITH t AS ({ORACLE["medication_change"]})
SELECT CAST(row_number() OVER (ORDER BY med_change_status) AS INT) AS place, * FROM t""",
    "ordered_by_list": f"""{_N}, a AS (SELECT age, {_AGES} AS hidden FROM norm GROUP BY age)
SELECT CAST(row_number() OVER (ORDER BY hidden, age) AS INT) AS place, age, n FROM a""",
    "export_round_trip": f"""{_T} SELECT CASE WHEN is_test THEN 'test' ELSE 'train' END AS data_split,
  count(*) AS n, CAST(sum(readmitted_30d) AS BIGINT) AS n_readmissions FROM tested GROUP BY is_test""",
    "summary_round_trip": f"""SELECT score AS model, roc_auc, lift_vs_random, 'rule' AS best_model,
  CAST(0.25 AS DOUBLE) AS auc_uplift FROM ({_compared(_S, _TWO_SCORES, "score")})""",
}

# scripts and round trips answer the same questions as the operators
ORACLE |= {f"script_{n}": ORACLE[n] for n in (
    "overall_rate", "rate_by_diagnosis", "specialty_volume", "utilization_tiers",
    "length_of_stay", "segment_matrix", "admission_type_join", "admission_source_join",
    "medication_change", "insulin_status")}
ORACLE |= {"csv_round_trip": ORACLE["overall_rate"], "dims_round_trip": ORACLE["admission_type_join"]}
