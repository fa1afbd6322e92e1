"""Column builders. Everything here is a native expression inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkrisk.spec import ICD9_DIABETES, ICD9_RANGES

__all__ = [
    "as_column", "quoted", "matches", "binary_label", "icd9_number", "icd9_range_group",
    "icd9_group", "band_lower",
    "band_midpoint", "ordinal", "row_count_eq", "row_sum", "flag_gt", "flag_ge",
    "clip_upper", "tier", "decode", "weighted_score", "cut", "ratio", "rate_pct",
    "mean_1dp", "divide", "round_stable", "hash32", "token_null",
]


def quoted(name: str) -> str:
    """Column name safe for hyphens and dots."""
    return "`" + name.replace("`", "``") + "`"


def as_column(col: str | Column) -> Column:
    return F.col(quoted(col)) if isinstance(col, str) else col


def matches(cond: Column) -> Column:
    """A predicate that is false, never null, where its input is null."""
    return F.coalesce(cond, F.lit(False))


def token_null(col: str | Column, tokens: Iterable[str]) -> Column:
    """Null where the text equals one of the tokens exactly."""
    c = as_column(col)
    return F.when(~c.isin(*tokens), c)


def binary_label(col: str | Column, positive) -> Column:
    """1 where the value equals ``positive``, else 0; null gives 0."""
    return matches(as_column(col) == F.lit(positive)).cast("int")


_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def icd9_number(col: str | Column) -> Column:
    """The code as a number; null for supplementary codes and other text.

    The guard keeps ``try_cast`` from accepting Java number suffixes ('1d').
    """
    c = as_column(col)
    return F.when(c.rlike(_NUMBER), F.trim(c).try_cast("double"))


def icd9_range_group(value: str | Column) -> Column:
    """Clinical group of a numeric code; ``Other`` for null and unlisted codes."""
    v = as_column(value)
    name, low, high = ICD9_DIABETES
    grouped = F.when((v >= low) & (v < high), F.lit(name))
    for name, low, high in ICD9_RANGES:
        inside = v == low if low == high else v.between(low, high)
        grouped = grouped.when(inside, F.lit(name))
    return grouped.otherwise("Other")


def icd9_group(col: str | Column) -> Column:
    """Clinical group of an ICD-9 code; null is ``Missing``.

    For whole tables ``icd9_groups`` of the operators parses each code only once.
    """
    return F.when(as_column(col).isNull(), F.lit("Missing")).otherwise(
        icd9_range_group(icd9_number(col)))


def _band_bound(col: str | Column, group: int) -> Column:
    text = F.regexp_extract(as_column(col), r"^\[?\s*(\d+)\s*-\s*(\d+)\s*\)?$", group)
    return F.when(text != "", text.try_cast("int"))


def band_lower(col: str | Column) -> Column:
    """Lower bound of a band such as ``[50-60)``; a sort key."""
    return _band_bound(col, 1)


def band_midpoint(col: str | Column) -> Column:
    """Midpoint of a band such as ``[50-60)``: 55.0."""
    return (_band_bound(col, 1) + _band_bound(col, 2)) / F.lit(2.0)


def decode(col: str | Column, mapping: Mapping, default=None) -> Column:
    """Simple CASE: value for each key, null (or ``default``) otherwise."""
    c = as_column(col)
    pairs = list(mapping.items())
    out = F.when(c == F.lit(pairs[0][0]), F.lit(pairs[0][1]))
    for key, value in pairs[1:]:
        out = out.when(c == F.lit(key), F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def ordinal(col: str | Column, mapping: Mapping[str, int]) -> Column:
    """Ordinal code of a level; unknown text and null give null."""
    return decode(col, mapping).cast("int")


def row_count_eq(cols: Sequence[str | Column], value) -> Column:
    """How many of the columns equal ``value`` in this row; null counts as no."""
    return reduce(add, [binary_label(c, value) for c in cols])


def row_sum(cols: Sequence[str | Column]) -> Column:
    return reduce(add, [as_column(c) for c in cols])


def flag_gt(col: str | Column, threshold) -> Column:
    return matches(as_column(col) > threshold).cast("int")


def flag_ge(col: str | Column, threshold) -> Column:
    return matches(as_column(col) >= threshold).cast("int")


def clip_upper(col: str | Column, cap) -> Column:
    """Value capped at ``cap``; null stays null (``least`` alone would return the cap)."""
    c = as_column(col)
    return F.when(c > cap, F.lit(cap)).otherwise(c)


def tier(col: str | Column, tiers: Sequence[tuple], otherwise: str) -> Column:
    """Searched CASE over inclusive ranges ``(low, high, label)``; null falls to ELSE."""
    c = as_column(col)
    low, high, label = tiers[0]
    out = F.when(c.between(low, high), F.lit(label))
    for low, high, label in tiers[1:]:
        out = out.when(c.between(low, high), F.lit(label))
    return out.otherwise(F.lit(otherwise))


def cut(col: str | Column, bins: Sequence[tuple]) -> Column:
    """Right-closed bins ``(low, high, label)`` meaning low < x <= high; else null."""
    c = as_column(col)
    low, high, label = bins[0]
    out = F.when((c > low) & (c <= high), F.lit(label))
    for low, high, label in bins[1:]:
        out = out.when((c > low) & (c <= high), F.lit(label))
    return out


def weighted_score(weights: Mapping[str, int]) -> Column:
    """Rule score: sum of weight x column."""
    return reduce(add, [as_column(c) * F.lit(w) for c, w in weights.items()])


def ratio(num: str | Column, den: str | Column, scale: int, places: int) -> Column:
    """``scale * num / den`` rounded half up to ``places`` for non-negative whole numbers.

    Integer arithmetic, so every engine gives the same digits; null when ``den`` is zero.
    """
    a, b = as_column(num).cast("long"), as_column(den).cast("long")
    unit = 10 ** places
    whole = F.call_function("div", a * (2 * scale * unit) + b, b * 2)
    return F.when(b > 0, whole.cast("double") / F.lit(float(unit)))


def rate_pct(num: str | Column, den: str | Column) -> Column:
    """Percent with two decimals: 1 of 800 is 0.13."""
    return ratio(num, den, 100, 2)


def mean_1dp(total: str | Column, n: str | Column) -> Column:
    """Mean of whole numbers with one decimal."""
    return ratio(total, n, 1, 1)


def divide(num: str | Column, den: str | Column, alt=0.0) -> Column:
    """Quotient, or ``alt`` when the denominator is zero or either side is null."""
    quotient = F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))
    return F.coalesce(quotient, F.lit(float(alt)))


def round_stable(col: str | Column, places: int = 6) -> Column:
    """Rounding that does not depend on the order in which doubles were added up.

    The value is first cut to fourteen significant digits, which removes summation noise,
    so a mean that is exactly halfway rounds up on every run.
    """
    c = as_column(col)
    plain = F.format_string("%.13e", c).cast("double")
    return F.round(F.when(c.isNotNull(), plain), places)


def hash32(key: str | Column, seed: int | None = None) -> Column:
    """First 32 bits of the md5 of ``seed:key`` (or of the key) as a long.

    The same value in every engine that has md5, stable when rows are added.
    """
    text = as_column(key).cast("string")
    if seed is not None:
        text = F.concat(F.lit(f"{seed}:"), text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
