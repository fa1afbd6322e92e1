"""Table profile: all columns in one pass, exact quantiles without collecting values.

``percentile`` keeps every distinct value of a column in one task. Here quantile sketches,
merged in a tree, only bracket the wanted ranks; a further pass counts the rows below each
bracket and groups and orders only the values inside it. A bracket that would hold more rows
than one task should order is narrowed first, by sketches of the values inside it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrisk.functions import as_column, quoted, rate_pct, round_stable
from sparkrisk.operators import sketch

#: size of the sketches; brackets hold about half a percent of the rows each
ACCURACY = 4096
#: more rows of a bracket than this are narrowed down before they are ordered
ROWS_IN_BRACKET = 1_000_000


def _long(df: DataFrame, cols: Sequence[str], **per_column) -> DataFrame:
    """One row per column from a one-row frame; ``per_column[name](i)`` gives the value."""
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), *[f(i).alias(n) for n, f in per_column.items()])
        for i, c in enumerate(cols)])
    return df.select(F.inline(rows))


def null_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percent of every column that has any, most nulls first."""
    cols = list(cols or df.columns)
    one = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.count(as_column(c)).alias(f"_c{i}") for i, c in enumerate(cols)])
    out = _long(one, cols, missing_count=lambda i: F.col("_n") - F.col(f"_c{i}"),
                _n=lambda i: F.col("_n"))
    return (
        out.filter(F.col("missing_count") > 0)
        .select("feature", "missing_count", rate_pct("missing_count", "_n").alias("missing_pct"))
        .orderBy(F.desc("missing_count"), "feature")
    )


def total_nulls(df: DataFrame) -> DataFrame:
    """Number of null cells in the whole table."""
    counts = [F.count_if(as_column(c).isNull()) for c in df.columns]
    one = df.agg(*[c.alias(f"_m{i}") for i, c in enumerate(counts)])
    total = F.lit(0).cast("long")
    for i in range(len(counts)):
        total = total + F.col(f"_m{i}")
    return one.select(total.alias("total_nulls"))


def cardinality(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column.

    Exact counts use one grouped pass over (column, value); ``approx`` one aggregate.
    """
    if approx:
        one = df.agg(*[F.approx_count_distinct(as_column(c)).alias(f"_d{i}")
                       for i, c in enumerate(cols)])
        return _long(one, cols, n_distinct=lambda i: F.col(f"_d{i}"))
    values = category_values(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)))
    found = values.groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return every.join(found, "feature", "left").select(
        "feature", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def category_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value) pairs as text, null left out."""
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), as_column(c).cast("string").alias("value"))
        for c in cols])
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull())


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Frequency of every ``column_value`` over several columns."""
    grouped = category_values(df, cols).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("n"))
    return grouped.select(F.concat_ws("_", "feature", "value").alias("name"), "n")


def near_zero_variance(df: DataFrame, cols: Sequence[str], threshold: float = 0.995) -> DataFrame:
    """Columns whose most frequent value covers more than ``threshold`` of all rows."""
    grouped = category_values(df, cols).groupBy("feature", "value").agg(
        F.count(F.lit(1)).alias("_c"))
    total = df.agg(F.count(F.lit(1))).scalar()
    share = F.col("_c").cast("double") / total
    top = grouped.groupBy("feature").agg(F.max("_c").alias("_c"))
    return top.filter(share > threshold).select("feature", F.round(share, 6).alias("top_share"))


# ------------------------------------------------------------------ quantiles

def _number(col: str) -> Column:
    """The column as a double, NaN taken as null."""
    return F.nanvl(as_column(col).cast("double"), F.lit(None).cast("double"))


def _summary(df: DataFrame, cols: Sequence[str], accuracy: int) -> list[dict]:
    """Per column: count, moments, ends and a quantile sketch (at most some k numbers)."""
    rows = df.select(*[_number(c).alias(f"c{i}") for i, c in enumerate(cols)])
    found = sketch.sketch_tree(rows, rows.columns, accuracy, moments=True).first()
    out = []
    for i in range(len(cols)):
        n = found[f"n{i}"] if found else 0
        m2 = found[f"moments{i}"]["m2"] if n else None
        out.append({
            "n": n, "mean": found[f"moments{i}"]["mean"] if n else None,
            "std": (m2 / (n - 1)) ** 0.5 if n > 1 else None,
            "low": found[f"low{i}"] if n else None, "high": found[f"high{i}"] if n else None,
            "sketch": found[f"s{i}"] if n else None})
    return out


def _ranks(n: int, probs: Sequence[float]) -> list[tuple[int, float]]:
    """Of each quantile the rank of the value below it, and how far it is to the next."""
    return [(math.floor((n - 1) * p) + 1, (n - 1) * p - math.floor((n - 1) * p)) for p in probs]


def _merged(ranges: Iterable[tuple[float, float]]) -> list[tuple[float, float]]:
    """Disjoint ascending ranges that cover the given ones."""
    out: list[tuple[float, float]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def _around(spark, wanted: Sequence[tuple], accuracy: int) -> list[tuple[float, float]]:
    """Value ranges that hold the ranks ``first`` to ``last``, from (sketch, n, low, high,
    first, last); wider than the sketch's error on both sides."""
    margin = sketch.MARGIN * sketch.rank_error(accuracy)
    shares = [((first - 1) / n - margin, (last + 1) / n + margin)
              for _, n, _, _, first, last in wanted]
    found = sketch.quantiles(spark, [
        (w[0], [min(1.0, max(0.0, s)) for s in share])
        for w, share in zip(wanted, shares, strict=True)])
    return [(low if share[0] <= 0 else q[0], high if share[1] >= 1 else q[1])
            for (_, _, low, high, _, _), share, q in zip(wanted, shares, found, strict=True)]


def _brackets(df: DataFrame, cols: Sequence[str], summary: list[dict], probs: Sequence[float],
              accuracy: int, most: int) -> list[list[tuple[float, float]]]:
    """Per column disjoint ascending value ranges that hold the wanted ranks.

    Ranges that may hold more than ``most`` rows of different values are narrowed: their rows
    are counted and sketched again, which leaves a few thousandths of them each time. A rank
    that turns out to lie beside its range is looked for in the gap next to it.
    """
    spark = df.sparkSession
    wanted = [(i, k, k + 1) for i, r in enumerate(summary) if r["n"]
              for k, _ in _ranks(r["n"], probs)]
    around = _around(spark, [
        (summary[i]["sketch"], summary[i]["n"], summary[i]["low"], summary[i]["high"], a, b)
        for i, a, b in wanted], accuracy)
    share = 2 * (sketch.MARGIN + 1) * sketch.rank_error(accuracy)
    held = [summary[i]["n"] * share for i, _, _ in wanted]

    def per_column() -> list[list[tuple[float, float]]]:
        return [_merged(r for (i, _, _), r in zip(wanted, around, strict=True) if i == col)
                for col in range(len(cols))]

    while share < 0.5 and any(n > most and low < high
                              for n, (low, high) in zip(held, around, strict=True)):
        ranges, known = per_column(), list(around)
        rows = _placed(df, cols, ranges).withColumn(
            "inside", F.when(F.col("place") % 2 == 1, F.col("value")))
        found = {(r["col"], r["place"]): r for r in sketch.sketch_tree(
            rows, ["inside"], accuracy, ["col", "place"]).collect()}
        inner, which = [], []
        for at, (i, first, last) in enumerate(wanted):
            m = next(m for m, (low, high) in enumerate(ranges[i])
                     if low <= around[at][0] and around[at][1] <= high)
            before = sum(r["rows"] for (col, place), r in found.items()
                         if col == i and place < 2 * m + 1)
            r = found.get((i, 2 * m + 1))
            n = r["n0"] if r else 0
            if first > before + n:
                after = ranges[i][m + 1][0] if m + 1 < len(ranges[i]) else summary[i]["high"]
                around[at] = (ranges[i][m][1], after)
            elif last <= before:
                around[at] = (ranges[i][m - 1][1] if m else summary[i]["low"], ranges[i][m][0])
            else:
                held[at] = n * share
                inner.append((r["s0"], n, r["low0"], r["high0"], first - before, last - before))
                which.append(at)
        for at, new in zip(which, _around(spark, inner, accuracy), strict=True):
            around[at] = new
        if around == known:  # as narrow as these sketches make it
            break
    return per_column()


def _placed(df: DataFrame, cols: Sequence[str],
            ranges: list[list[tuple[float, float]]]) -> DataFrame:
    """(col, place, value) of every value of the columns that have ranges.

    Even places are the gaps between ranges, odd places the ranges.
    """
    values = []
    for i, own in enumerate(ranges):
        if not own:
            continue
        v = _number(cols[i])
        place = F.when(v.isNull(), F.lit(None))
        for m, (low, high) in enumerate(own):
            place = place.when(v < F.lit(low), 2 * m).when(v <= F.lit(high), 2 * m + 1)
        place = place.otherwise(2 * len(own))
        values.append(F.struct(F.lit(i).alias("col"), place.alias("place"), v.alias("value")))
    return df.select(F.inline(F.array(*values))).filter(F.col("place").isNotNull())


def _select_ranks(df: DataFrame, cols: Sequence[str], summary: list[dict],
                  probs: Sequence[float], accuracy: int, most: int) -> DataFrame:
    """Exact quantiles as ``(col, q0, q1, ...)``.

    The brackets cut the values of a column into intervals: even numbers are the gaps
    between brackets, odd numbers the brackets. A gap becomes one group, a bracket one
    group per distinct value; running counts over these groups give the ranks. A wanted
    rank is inside a bracket or the first or last value of a gap.
    """
    wanted = [(i, j, k, frac) for i, r in enumerate(summary) if r["n"]
              for j, (k, frac) in enumerate(_ranks(r["n"], probs))]
    targets = df.sparkSession.createDataFrame(wanted, "col int, j int, k long, frac double")
    if not wanted:
        return targets.groupBy("col").agg(*[
            F.max(F.lit(None).cast("double")).alias(f"q{j}") for j in range(len(probs))])

    rows = _placed(df, cols, _brackets(df, cols, summary, probs, accuracy, most))
    bracket = F.col("place") % 2 == 1
    groups = rows.groupBy("col", "place", F.when(bracket, F.col("value")).alias("inside")).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
    # rows before each gap or bracket (a few per column), then order inside each bracket
    order = Window.partitionBy("col").orderBy("place")
    before = groups.groupBy("col", "place").agg(F.sum("n").alias("held")).select(
        "col", "place", (F.sum("held").over(order.rowsBetween(Window.unboundedPreceding, 0))
                         - F.col("held")).alias("before"))
    inner = Window.partitionBy("col", "place").orderBy("inside")
    ranked = groups.join(F.broadcast(before), ["col", "place"]).withColumn(
        "upto", F.col("before") + F.sum("n").over(
            inner.rowsBetween(Window.unboundedPreceding, 0)))
    start, upto = F.col("upto") - F.col("n"), F.col("upto")

    def at_rank(rank: Column) -> Column:
        held = F.when(bracket | (rank == upto), F.col("most")).when(
            rank == start + 1, F.col("least"))
        return F.max(F.when((start < rank) & (rank <= upto), held))

    near = ranked.join(F.broadcast(targets), "col")
    both = near.groupBy("col", "j", "frac").agg(
        at_rank(F.col("k")).alias("a"), at_rank(F.col("k") + 1).alias("b"))
    value = F.when(F.col("frac") == 0, F.col("a")).otherwise(
        F.col("a") + F.col("frac") * (F.col("b") - F.col("a")))
    missed = F.raise_error(F.lit("a wanted rank lies outside its bracket")).cast("double")
    found = both.select("col", "j", F.coalesce(value, missed).alias("value"))
    return found.groupBy("col").agg(*[
        F.max(F.when(F.col("j") == j, F.col("value"))).alias(f"q{j}")
        for j in range(len(probs))])


def _name(cols: Sequence[str]) -> Column:
    return F.element_at(F.lit(list(cols)), F.col("col") + 1).alias("feature")


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    accuracy: int = ACCURACY, most: int = ROWS_IN_BRACKET) -> DataFrame:
    """Exact linear-interpolated quantiles as ``(feature, q0, q1, ...)``.

    ``accuracy`` is the size of the sketches, 8 to 65,535. Two passes over the data for all
    columns and probabilities together, and one more per factor of some 200 by which a
    bracket's rows exceed ``most``, the rows of different values that one task may order.
    """
    found = _select_ranks(df, cols, _summary(df, cols, accuracy), probs, accuracy, most)
    return found.select(_name(cols), *[f"q{j}" for j in range(len(probs))])


def describe_numeric(df: DataFrame, cols: Sequence[str],
                     accuracy: int = ACCURACY) -> DataFrame:
    """Count, mean, standard deviation (n - 1), minimum, quartiles and maximum."""
    probs = [0.25, 0.5, 0.75]
    summary = _summary(df, cols, accuracy)
    rows = [(i, r["n"], r["mean"], r["std"], r["low"], r["high"]) for i, r in enumerate(summary)]
    basic = df.sparkSession.createDataFrame(
        rows, "col int, count long, mean double, std double, min double, max double")
    ranks = _select_ranks(df, cols, summary, probs, accuracy, ROWS_IN_BRACKET)
    return basic.join(ranks, "col", "left").select(
        _name(cols), "count", round_stable("mean").alias("mean"), round_stable("std").alias("std"),
        "min", F.round("q0", 6).alias("p25"), F.round("q1", 6).alias("p50"),
        F.round("q2", 6).alias("p75"), "max")


def _fences(df: DataFrame, cols: Sequence[str], k: float, accuracy: int):
    """Quartiles and outlier fences per column, collected (one row per column)."""
    out = {}
    for r in exact_quantiles(df, cols, [0.25, 0.5, 0.75], accuracy).collect():
        q1, q2, q3 = r["q0"], r["q1"], r["q2"]
        out[r["feature"]] = (q1, q2, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
    return out


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5,
                 accuracy: int = ACCURACY) -> DataFrame:
    """Quartiles, fences and rows strictly outside them, for all columns in one pass."""
    fences = _fences(df, cols, k, accuracy)
    known = [c for c in cols if c in fences]
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count_if((_number(c) < fences[c][3]) | (_number(c) > fences[c][4])).alias(f"_o{i}")
        for i, c in enumerate(known)])
    out = _long(one, known,
                q1=lambda i: F.lit(round(fences[known[i]][0], 6)),
                q3=lambda i: F.lit(round(fences[known[i]][2], 6)),
                lower_bound=lambda i: F.lit(round(fences[known[i]][3], 6)),
                upper_bound=lambda i: F.lit(round(fences[known[i]][4], 6)),
                n_outliers=lambda i: F.col(f"_o{i}"), _n=lambda i: F.col("_n"))
    return out.select("feature", "q1", "q3", "lower_bound", "upper_bound", "n_outliers",
                      rate_pct("n_outliers", "_n").alias("pct_outliers"))


def box_stats(df: DataFrame, cols: Sequence[str], k: float = 1.5,
              accuracy: int = ACCURACY) -> DataFrame:
    """Quartiles, whisker ends (last values inside the fences) and outlier count."""
    fences = _fences(df, cols, k, accuracy)
    known = [c for c in cols if c in fences]
    aggs = []
    for i, c in enumerate(known):
        v = _number(c)
        inside = v.between(fences[c][3], fences[c][4])
        aggs += [F.min(F.when(inside, v)).alias(f"_l{i}"), F.max(F.when(inside, v)).alias(f"_h{i}"),
                 F.count_if(~inside).alias(f"_o{i}")]
    return _long(df.agg(*aggs), known,
                 q1=lambda i: F.lit(round(fences[known[i]][0], 6)),
                 median=lambda i: F.lit(round(fences[known[i]][1], 6)),
                 q3=lambda i: F.lit(round(fences[known[i]][2], 6)),
                 whisker_low=lambda i: F.col(f"_l{i}"), whisker_high=lambda i: F.col(f"_h{i}"),
                 n_outliers=lambda i: F.col(f"_o{i}"))


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 30) -> DataFrame:
    """Equal-width bins per column, the last one closed; empty bins have n = 0.

    NaN counts as null. A column with a single value has one bin, number 0; one without
    values has none.
    """
    ends = df.agg(*[f(_number(c)).alias(f"{n}{i}")
                    for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    marks, every = [], []
    for i, c in enumerate(cols):
        low, high = ends[f"lo{i}"], ends[f"hi{i}"]
        if low is None:
            continue
        v = _number(c)
        width = (high - low) / bins
        every.append((c, low, width, 1 if width == 0 else bins))
        slot = F.lit(0) if width == 0 else F.least(
            F.floor((v - F.lit(low)) / F.lit(width)).cast("int"), F.lit(bins - 1))
        marks.append(F.when(v.isNotNull(), F.struct(
            F.lit(c).alias("feature"), slot.alias("bin"))))
    if not marks:
        return df.sparkSession.createDataFrame(
            [], "feature string, bin int, bin_start double, n long")
    rows = df.select(F.inline(F.array_compact(F.array(*marks))))
    found = rows.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.createDataFrame(
        every, "feature string, low double, width double, bins int").select(
        "feature", "low", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    return grid.join(found, ["feature", "bin"], "left").select(
        "feature", "bin", F.round(F.col("low") + F.col("bin") * F.col("width"), 6)
        .alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


# ---------------------------------------------------------------- correlation

def corr_matrix(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, upper triangle.

    Each task sums the products of its rows block by block, as matrix products over all
    columns at once, and gives one row per pair; only these are shuffled, however many rows
    there are. Values are taken relative to their means, so that large numbers cancel nothing.
    Rows without one of the two values do not count for a pair.
    """
    cols = list(cols)
    pairs = [(i, j) for i in range(len(cols)) for j in range(i + 1, len(cols))]
    rows = df.select(*[_number(c).alias(f"_{i}") for i, c in enumerate(cols)])
    mean = rows.agg(*[F.avg(c).alias(c) for c in rows.columns]).first()
    centre = np.array([mean[c] or 0.0 for c in rows.columns])
    a, b = (np.array([p[side] for p in pairs], dtype=np.int64) for side in (0, 1))
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), len(pairs)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns],
                         axis=1) - centre
            there = ~np.isnan(x)
            x[~there] = 0.0
            held = there.astype(float)
            once, twice = x.T @ held, (x * x).T @ held
            total += np.stack([(held.T @ held)[a, b], once[a, b], once[b, a], twice[a, b],
                               twice[b, a], (x.T @ x)[a, b]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(pairs), dtype=np.int32)), *map(pa.array, total)],
            names=["pair", *names])

    parts = rows.mapInArrow(sums, "pair int, " + ", ".join(f"{c} double" for c in names))
    one = parts.groupBy("pair").agg(*[F.sum(c).alias(c) for c in names])
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in names)
    spread = F.sqrt((sxx - sx * sx / n) * (syy - sy * sy / n))
    r = F.when(n > 0, F.try_divide(sxy - sx * sy / n, spread))
    listed = [[cols[p[side]] for p in pairs] for side in (0, 1)]
    return one.select(
        *[F.element_at(F.lit(n_), F.col("pair") + 1).alias(f"feature_{s}")
          for n_, s in zip(listed, "ab")], round_stable(r).alias("r"))


def corr_with(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    """Correlation of each column with the label, strongest positive first."""
    y = _number(label)
    one = df.agg(*[F.corr(_number(c), y).alias(f"r{i}")
                   for i, c in enumerate(cols)])
    return _long(one, cols, r=lambda i: round_stable(f"r{i}")).orderBy(
        F.desc_nulls_last("r"), quoted("feature"))
