"""Raw encounters derived from the orders / lineitem / customer star.

One encounter per order: the customer is the patient, the order priority the admission
type, and history features come from the customer's other orders. Used as the input of
the registered queries because no encounter file ships with the test data.

History is computed on one row per customer and calendar day, so the window group of
even the busiest customer is bounded by the number of days, not by its orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkrisk.functions import decode
from sparkrisk.spec import KEPT_MEDICATIONS, RARE_MEDICATIONS, RAW_SCHEMA

PAYERS = {0: "MC", 1: "HM", 2: "SP", 3: "BC", 4: "MD", 5: "CP", 6: "UN"}
ADMISSION_TYPES = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3, "4-NOT SPECIFIED": 5}
# (column, modulus and remainder of the missing codes, multiplier)
DIAGNOSIS_RULES = (("diag_1", 1999, 7, 37), ("diag_2", 281, 5, 53), ("diag_3", 71, 9, 71))
DOSAGE_FACTORS = (3, 7, 9, 11, 13, 17, 19, 21, 23, 27)
HISTORY_DAYS = 365


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _text(c: Column) -> Column:
    return c.cast("string")


def _diagnosis(k: Column, modulus: int, missing: int, factor: int) -> Column:
    return (
        F.when(k % modulus == missing, "?")
        .when(k % 11 == 0, F.concat(F.lit("V"), _text(k % 90)))
        .when(k % 13 == 0, F.concat(F.lit("E"), _text(k % 190 + 800)))
        .when(k % 9 == 0, F.concat(F.lit("250."), _text(k % 100)))
        .when(k % 17 == 0, _text(k % 5 + 785))
        .otherwise(_text((k * factor) % 862 + 139))
    )


def _daily_history(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """One row per (customer, day): visits of the year before, next day with an order."""
    daily = orders.groupBy("c", "day").agg(
        F.max("k").alias("last_k"),
        F.count_if(F.col("priority") == "2-HIGH").alias("inpatient"),
        F.count_if(F.col("priority") == "1-URGENT").alias("emergency"),
        F.count_if(~F.col("priority").isin("2-HIGH", "1-URGENT")).alias("outpatient"),
    )
    by_day = Window.partitionBy("c").orderBy("day")
    year = by_day.rangeBetween(-HISTORY_DAYS, -1)
    counted = daily.select(
        "c", "day", "last_k", F.lead("day").over(by_day).alias("next_day"),
        *[F.coalesce(F.sum(v).over(year), F.lit(0)).cast("int").alias(f"number_{v}")
          for v in ("inpatient", "emergency", "outpatient")],
    )
    nations = customer.select(F.col("c_custkey").alias("c"),
                              F.col("c_nationkey").alias("nation"))
    return counted.join(nations, "c")


def encounter_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tables say of each encounter: the few columns that need joins and windows."""
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"),
        F.col("o_orderpriority").alias("priority"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
        .alias("day"),
    )
    items = read_table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("returned"),
        F.sum("l_quantity").cast("long").alias("quantity"),
    )
    history = _daily_history(orders, read_table(spark, sf_dir, "customer"))
    return orders.join(items, "k", "left").join(history, ["c", "day"])


def raw_columns(rows: DataFrame) -> DataFrame:
    """The 50-column raw table from :func:`encounter_facts`, row by row.

    Most columns are texts that follow from two keys: a stage table holds the facts, and who
    reads it derives the columns it needs.
    """
    k, c, day = F.col("k"), F.col("c"), F.col("day")
    decade = (c * 7 + 3) % 10
    disposition = k % 97
    dose = [(k * p + c) % 20 for p in DOSAGE_FACTORS]
    changed = (dose[0] < 2) | (dose[1] < 2) | (dose[2] < 2) | (dose[3] < 2)
    gap = F.when(k < F.col("last_k"), 0).otherwise(F.col("next_day") - day)

    columns = {
        "encounter_id": k,
        "patient_nbr": c,
        "race": F.when(c % 45 == 0, "?").when(c % 9 < 6, "Caucasian")
                 .when(c % 9 < 8, "AfricanAmerican").otherwise("Other"),
        "gender": F.when(c % 500 == 499, "Unknown/Invalid")
                   .when(c % 2 == 0, "Female").otherwise("Male"),
        "age": F.concat(F.lit("["), _text(decade * 10), F.lit("-"),
                        _text((decade + 1) * 10), F.lit(")")),
        "weight": F.when(k % 31 == 0, "[75-100)").otherwise("?"),
        "admission_type_id": decode("priority", ADMISSION_TYPES, 6),
        "discharge_disposition_id":
            F.when(disposition < 60, 1).when(disposition < 75, 3).when(disposition < 88, 6)
             .when(disposition == 88, 11).when(disposition == 89, 13)
             .when(disposition == 90, 20).when(disposition < 95, 22).otherwise(18),
        "admission_source_id": F.col("nation") % 25 + 1,
        "time_in_hospital": (k * 13) % 14 + 1,
        "payer_code": F.when(c % 5 < 2, "?").otherwise(decode(c % 7, PAYERS)),
        "medical_specialty": F.when(k % 2 == 0, "?").otherwise(
            F.concat(F.lit("Specialty-"), _text(F.floor(F.sqrt((k * 31) % 5329))))),
        "num_lab_procedures": (k * 31) % 132 + 1,
        "num_procedures": F.least(F.coalesce("returned", F.lit(0)), F.lit(6)),
        "num_medications": F.coalesce("quantity", F.lit(0)) % 81 + 1,
        "number_outpatient": F.col("number_outpatient"),
        "number_emergency": F.col("number_emergency"),
        "number_inpatient": F.col("number_inpatient"),
        **{name: _diagnosis(k, *rule) for name, *rule in DIAGNOSIS_RULES},
        "number_diagnoses": (k * 5) % 9 + 1,
        "max_glu_serum": decode(k % 40, {0: ">200", 1: ">300", 2: "Norm"}, "None"),
        "A1Cresult": decode(k % 12, {0: ">7", 1: ">8", 2: "Norm"}, "None"),
        **{name: F.when(v == 0, "Up").when(v == 1, "Down").when(v <= 6, "Steady")
                  .otherwise("No") for name, v in zip(KEPT_MEDICATIONS, dose)},
        **{name: F.when(k % 401 == i, "Steady").otherwise("No")
           for i, name in enumerate(RARE_MEDICATIONS)},
        "change": F.when(changed, "Ch").otherwise("No"),
        "diabetesMed": F.when(k % 4 == 0, "No").otherwise("Yes"),
        "readmitted": F.when(gap.isNull(), "NO").when(gap <= 30, "<30").otherwise(">30"),
    }
    return rows.select(*[
        columns[f.name].cast(f.dataType).alias(f.name) for f in RAW_SCHEMA.fields])


def encounters_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50-column raw table, ``?`` and ``None`` still in place."""
    return raw_columns(encounter_facts(spark, sf_dir))
