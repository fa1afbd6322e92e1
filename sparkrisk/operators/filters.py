"""Row filters and column-wise cleaning steps. Null handling is explicit everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrisk.functions import (
    as_column, icd9_number, icd9_range_group, ordinal, quoted, token_null,
)


def null_tokens(df: DataFrame, tokens: Iterable[str], cols: Sequence[str] | None = None,
                per_column: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Null out exact tokens in every string column (or ``cols``), in one projection."""
    per_column = dict(per_column or {})
    chosen = set(cols) if cols is not None else {
        f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.withColumns({
        c: token_null(c, tuple(per_column.get(c, tokens)))
        for c in df.columns if c in chosen or c in per_column})


def exclude_codes(df: DataFrame, col: str, codes: Iterable) -> DataFrame:
    """Drop rows whose code is listed; rows with a null code stay. Pushed to the scan."""
    c = as_column(col)
    return df.filter(c.isNull() | ~c.isin(*codes))


def exclude_value(df: DataFrame, col: str, value) -> DataFrame:
    """Drop rows equal to ``value``; null stays."""
    c = as_column(col)
    return df.filter(c.isNull() | (c != F.lit(value)))


def fill_categories(df: DataFrame, fills: Mapping[str, str]) -> DataFrame:
    return df.fillna(dict(fills))


def ordinal_encode(df: DataFrame, cols: Sequence[str], mapping: Mapping[str, int]) -> DataFrame:
    """Replace levels by their ordinal code in all columns at once."""
    return df.withColumns({c: ordinal(c, mapping) for c in cols})


def icd9_groups(df: DataFrame, cols: Sequence[str], suffix: str = "_group") -> DataFrame:
    """Add the clinical group of each code column.

    Codes are parsed in a projection of their own; Spark keeps it apart because the
    number is used many times above it, so every code is parsed once.
    """
    parsed = df.withColumns({f"_{c}": icd9_number(c) for c in cols})
    return parsed.withColumns({
        f"{c}{suffix}": F.when(as_column(c).isNull(), "Missing").otherwise(
            icd9_range_group(f"_{c}")) for c in cols}).drop(*[f"_{c}" for c in cols])


def top_values(df: DataFrame, col: str, k: int) -> DataFrame:
    """The ``k`` most frequent non-null values; ties go to the smaller value."""
    c = as_column(col)
    return (
        df.filter(c.isNotNull()).groupBy(c.alias(col)).agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(quoted(col))).limit(k)
    )


def collapse_top_k(df: DataFrame, col: str, k: int, other: str,
                   population: DataFrame | None = None) -> DataFrame:
    """Keep the ``k`` most frequent values, replace the rest and null by ``other``.

    Frequencies come from ``population`` (default: ``df``). The broadcast side has at
    most ``k`` rows by construction.
    """
    top = top_values(population if population is not None else df, col, k)
    marked = df.join(
        F.broadcast(top.select(as_column(col).alias("_top"))),
        as_column(col) == F.col("_top"), "left")
    return marked.withColumn(col, F.coalesce("_top", F.lit(other))).drop("_top")


def keep_members(df: DataFrame, col: str, members: DataFrame) -> DataFrame:
    """Rows whose value is listed in the first column of ``members``."""
    listed = members.select(F.col(quoted(members.columns[0])).alias("_member"))
    return df.join(listed, as_column(col) == F.col("_member"), "left_semi")


def drop_members(df: DataFrame, col: str, members: DataFrame) -> DataFrame:
    """Rows whose value is not listed (set difference); null values stay."""
    listed = members.select(F.col(quoted(members.columns[0])).alias("_member"))
    return df.join(listed, as_column(col) == F.col("_member"), "left_anti")


def slice_by(df: DataFrame, **equals) -> DataFrame:
    """Conjunction of equality filters; a list or tuple means any of its values."""
    for col, value in equals.items():
        many = isinstance(value, (list, tuple, set))
        df = df.filter(as_column(col).isin(*value) if many else as_column(col) == value)
    return df


def order_by_list(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    """Sort by the position of the value in a fixed list; unlisted values last."""
    place = F.array_position(F.array(*[F.lit(v) for v in values]), as_column(col))
    return df.orderBy(F.when(place > 0, place).otherwise(len(values) + 1), as_column(col))
