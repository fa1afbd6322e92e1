"""Column groups, codes and thresholds of the encounter domain.

Everything an operator needs to know about the domain is a value of
``EncounterSpec``; the operators themselves are generic.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# --- fixed values: codes, word lists and maps that must match the data set ---

EXPIRED_OR_HOSPICE_CODES = (11, 13, 14, 19, 20, 21)

KEPT_MEDICATIONS = (
    "metformin", "repaglinide", "nateglinide", "glimepiride", "glipizide",
    "glyburide", "pioglitazone", "rosiglitazone", "insulin",
    "glyburide-metformin",
)

RARE_MEDICATIONS = (
    "chlorpropamide", "acetohexamide", "tolbutamide", "acarbose", "miglitol",
    "troglitazone", "tolazamide", "examide", "citoglipton",
    "glipizide-metformin", "glimepiride-pioglitazone",
    "metformin-rosiglitazone", "metformin-pioglitazone",
)

DOSAGE_LEVELS = {"No": 0, "Down": 1, "Steady": 2, "Up": 3}

# (group, lowest code, highest code), both ends inclusive, compared as numbers.
ICD9_RANGES = (
    ("Circulatory", 390, 459), ("Circulatory", 785, 785),
    ("Respiratory", 460, 519), ("Respiratory", 786, 786),
    ("Digestive", 520, 579), ("Digestive", 787, 787),
    ("Injury", 800, 999),
    ("Musculoskeletal", 710, 739),
    ("Genitourinary", 580, 629), ("Genitourinary", 788, 788),
    ("Neoplasms", 140, 239),
)
# Half-open range [250, 251): every 250.xx sub-code.
ICD9_DIABETES = ("Diabetes", 250, 251)

UTILIZATION_TIERS = (
    (0, 0, "0 - No prior visits"),
    (1, 2, "1-2 - Low utilization"),
    (3, 5, "3-5 - Moderate utilization"),
)
UTILIZATION_TIER_ELSE = "6+ - High utilization"

SEGMENT_TIERS = (
    (0, 0, "No prior visits"),
    (1, 2, "Low utilization"),
    (3, 5, "Moderate utilization"),
)
SEGMENT_TIER_ELSE = "High utilization"

RISK_BANDS = (
    (0, 2, "High Risk (Top 20%)"),
    (2, 5, "Medium Risk (Mid 30%)"),
    (5, 10, "Low Risk (Bottom 50%)"),
)

RULE_WEIGHTS = {
    "service_utilization": 3,
    "had_prior_inpatient": 2,
    "num_med_increased": 2,
    "number_diagnoses": 1,
}

VISIT_COUNTS = ("number_outpatient", "number_emergency", "number_inpatient")

PROFILE_NUMERIC = (
    "time_in_hospital", "num_lab_procedures", "num_procedures",
    "num_medications", "number_outpatient", "number_emergency",
    "number_inpatient", "number_diagnoses",
)

DIAGNOSES = ("diag_1", "diag_2", "diag_3")

FEATURE_CATEGORICAL = (
    "gender", "admission_type_id", "discharge_disposition_id",
    "admission_source_id", "medical_specialty", "max_glu_serum",
    "A1Cresult", "diag_1_group", "diag_2_group", "diag_3_group",
)

FEATURE_NUMERIC = PROFILE_NUMERIC + ("age_numeric",) + KEPT_MEDICATIONS + (
    "change", "diabetesMed", "num_med_increased", "num_med_decreased",
    "service_utilization", "had_prior_inpatient",
)

FAIRNESS_COLUMNS = ("race", "payer_code")

WORKLIST_COLUMNS = (
    "encounter_id", "patient_nbr", "predicted_risk_probability",
    "predicted_risk_decile", "diag_1_group", "age_numeric",
    "number_inpatient", "service_utilization", "time_in_hospital",
    "discharge_disposition_id", "medical_specialty", "readmitted_30d",
)

# --- end of fixed values ---


def _struct(*parts: tuple[T.DataType, tuple[str, ...]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for t, names in parts for n in names])


_LONG, _INT, _STR, _DBL = T.LongType(), T.IntegerType(), T.StringType(), T.DoubleType()

RAW_SCHEMA = _struct(
    (_LONG, ("encounter_id", "patient_nbr")),
    (_STR, ("race", "gender", "age", "weight")),
    (_INT, ("admission_type_id", "discharge_disposition_id",
            "admission_source_id", "time_in_hospital")),
    (_STR, ("payer_code", "medical_specialty")),
    (_INT, ("num_lab_procedures", "num_procedures", "num_medications",
            "number_outpatient", "number_emergency", "number_inpatient")),
    (_STR, DIAGNOSES),
    (_INT, ("number_diagnoses",)),
    (_STR, ("max_glu_serum", "A1Cresult")),
    (_STR, KEPT_MEDICATIONS),
    (_STR, RARE_MEDICATIONS),
    (_STR, ("change", "diabetesMed", "readmitted")),
)

CLEAN_SCHEMA = _struct(
    (_LONG, ("encounter_id", "patient_nbr")),
    (_STR, ("race", "gender")),
    (_INT, ("admission_type_id", "discharge_disposition_id",
            "admission_source_id", "time_in_hospital")),
    (_STR, ("payer_code", "medical_specialty")),
    (_INT, ("num_lab_procedures", "num_procedures", "num_medications",
            "number_outpatient", "number_emergency", "number_inpatient",
            "number_diagnoses")),
    (_STR, ("max_glu_serum", "A1Cresult")),
    (_INT, KEPT_MEDICATIONS),
    (_INT, ("change", "diabetesMed", "readmitted_30d")),
    (_STR, ("diag_1_group", "diag_2_group", "diag_3_group")),
    (_DBL, ("age_numeric",)),
    (_INT, ("num_med_increased", "num_med_decreased",
            "service_utilization", "had_prior_inpatient")),
)


def lookup_schema(key: str) -> T.StructType:
    return T.StructType([T.StructField(key, _INT), T.StructField("description", _STR)])


@dataclass(frozen=True)
class EncounterSpec:
    """One domain preset; pass a changed copy (``dataclasses.replace``) to adapt it."""

    id: str = "encounter_id"
    group: str = "patient_nbr"
    label: str = "readmitted_30d"
    raw_label: str = "readmitted"
    positive: str = "<30"
    null_tokens: tuple[str, ...] = ("?",)
    lab_null_tokens: tuple[str, ...] = ("?", "None")
    lab_columns: tuple[str, ...] = ("max_glu_serum", "A1Cresult")
    leakage_column: str = "discharge_disposition_id"
    leakage_codes: tuple[int, ...] = EXPIRED_OR_HOSPICE_CODES
    dropped: tuple[str, ...] = ("weight",) + RARE_MEDICATIONS
    fills: dict = field(default_factory=lambda: {
        "race": "Unknown", "A1Cresult": "Not Tested", "max_glu_serum": "Not Tested",
    })
    top_k: dict = field(default_factory=lambda: {
        "medical_specialty": (10, "Other/Missing"),
        "payer_code": (5, "Other/Unknown"),
    })
    invalid_gender: str = "Unknown/Invalid"
    medications: tuple[str, ...] = KEPT_MEDICATIONS
    dosage: dict = field(default_factory=lambda: dict(DOSAGE_LEVELS))
    numeric: tuple[str, ...] = FEATURE_NUMERIC
    categorical: tuple[str, ...] = FEATURE_CATEGORICAL
    fairness: tuple[str, ...] = FAIRNESS_COLUMNS
    rule_weights: dict = field(default_factory=lambda: dict(RULE_WEIGHTS))
    seed: int = 42
    test_size: float = 0.2

    def features(self, include_fairness: bool = False) -> tuple[list[str], list[str]]:
        """Numeric and categorical model inputs."""
        extra = self.fairness if include_fairness else ()
        return list(self.numeric), list(self.categorical + extra)


ENCOUNTERS = EncounterSpec()
