"""Whole-group train / test split as a pure function of the group key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrisk.functions import as_column, hash32

STEP = 4
ORDERED_KEYS = 50_000


def _digest(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), as_column(key).cast("string")))


def in_test_hash(key: str, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for keys whose hash falls in the test share: no shuffle, stable under growth."""
    return hash32(key, seed) < F.lit(int(test_size * 2 ** 32)).cast("long")


def in_test_exact(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42) -> Column:
    """True for exactly ``ceil(test_size * groups)`` keys, those with the smallest md5.

    Keys are counted per md5 prefix, ``STEP`` digits further inside the prefix that holds
    the last test key until few enough keys are left to be ordered. The driver gets at most
    16 ** STEP counts a time, and the result is a comparison with one key, so rows are never
    joined.
    """
    keys = df.select(as_column(key).alias("_key")).filter(F.col("_key").isNotNull()).distinct()
    keys = keys.select("_key", _digest("_key", seed).alias("_md5"))
    wanted, name, near = None, "", keys
    while True:
        prefix = F.substring("_md5", 1, len(name) + STEP)
        counts = near.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
        per_prefix = sorted((r["_p"], r["_n"]) for r in counts.collect())
        if wanted is None:
            wanted = math.ceil(test_size * sum(n for _, n in per_prefix) - 1e-9)
            if wanted == 0:
                return F.lit(False)
        for name, n in per_prefix:
            if n >= wanted:
                break
            wanted -= n
        near = keys.filter(F.col("_md5").startswith(name))
        if n <= ORDERED_KEYS or len(name) >= 32:
            break
    last = near.orderBy("_md5", "_key").offset(wanted - 1).limit(1).first()
    digest, column = _digest(key, seed), as_column(key)
    return (digest < last["_md5"]) | (
        (digest == last["_md5"]) & (column <= F.lit(last["_key"])))


def sample_rows(df: DataFrame, id: str, most: int | None, seed: int = 42) -> DataFrame:
    """About ``most`` rows chosen by the hash of their id; all rows if there are no more."""
    rows = df.count() if most is not None else 0
    if most is None or rows <= most:
        return df
    return df.filter(hash32(id, seed) < F.lit(int(most / rows * 2 ** 32)).cast("long"))


def group_split(df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42,
                exact: bool = False) -> DataFrame:
    """Add ``data_split`` and ``is_out_of_sample_prediction``."""
    test = in_test_exact(df, key, test_size, seed) if exact else in_test_hash(
        key, test_size, seed)
    test = F.coalesce(test, F.lit(False))
    return df.withColumns({
        "data_split": F.when(test, "test").otherwise("train"),
        "is_out_of_sample_prediction": test,
    })


def out_of_sample(df: DataFrame) -> DataFrame:
    return df.filter(F.col("data_split") == "test")


def split_overlap(df: DataFrame, key: str, split: str = "data_split") -> DataFrame:
    """Groups found on both sides: one row with the number of groups and of such groups."""
    per_key = df.groupBy(as_column(key).alias("_key")).agg(
        F.min(split).alias("_a"), F.max(split).alias("_b"))
    return per_key.agg(F.count(F.lit(1)).alias("n_groups"),
                       F.count_if(F.col("_a") != F.col("_b")).alias("n_in_both"))


def assert_disjoint(a: DataFrame, b: DataFrame, key: str) -> None:
    """Raise if any key is found in both tables."""
    shared = a.select(as_column(key)).intersect(b.select(as_column(key)))
    if not shared.isEmpty():
        raise ValueError(f"{key}: both tables hold some of the same groups")
