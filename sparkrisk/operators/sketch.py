"""Quantile sketches merged in a tree.

One sketch per input partition is unavoidable, one task that merges them all is not: the
sketches of ``FAN_IN`` neighbouring groups are merged at a time, in as many rounds as the
number of groups needs, which follows the shuffle partitions. Counts, ends and moments of the
values travel with the sketches and are merged the same way.

Sketches are KLL. With size ``k`` a rank is off by more than ``rank_error(k)`` of the rows once
in a hundred times; callers take ``MARGIN`` times that, which is some eight deviations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FAN_IN = 16
MARGIN = 3.0
LEAST_K, MOST_K = 8, 65_535


def rank_error(k: int) -> float:
    """Share of the rows by which a rank of a sketch of size ``k`` may be off."""
    return 2.296 / k ** 0.9723


def _joined(a: Column, b: Column) -> Column:
    """Count, mean and squared deviations of two groups together."""
    n = a["n"] + b["n"]
    step = b["mean"] - a["mean"]
    both = F.struct(
        n.alias("n"), (a["mean"] + step * b["n"] / n).alias("mean"),
        (a["m2"] + b["m2"] + step * step * a["n"] * b["n"] / n).alias("m2"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def sketch_tree(rows: DataFrame, cols: Sequence[str], k: int, keys: Sequence[str] = (),
                moments: bool = False) -> DataFrame:
    """One row per ``keys``: ``rows``, and per column i of ``cols`` n{i}, low{i}, high{i}, s{i}.

    Columns are doubles; nulls are left out, ``s{i}`` is the sketch of the others. ``moments``
    adds moments{i} (n, mean, m2). No task merges more than ``FAN_IN`` sketches of a key after
    those of its input partitions, and those by as many groups as there are shuffle partitions.
    """
    groups = max(FAN_IN, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = {"rows": F.count(F.lit(1))}
    after = {"rows": F.sum("rows").alias("rows")}
    for i, c in enumerate(cols):
        v = F.col(c)
        first |= {f"n{i}": F.count(v), f"low{i}": F.min(v), f"high{i}": F.max(v),
                  f"s{i}": F.kll_sketch_agg_double(v, k)}
        after |= {f"n{i}": F.sum(f"n{i}"), f"low{i}": F.min(f"low{i}"),
                  f"high{i}": F.max(f"high{i}"), f"s{i}": F.kll_merge_agg_double(f"s{i}", k)}
        if moments:
            none = F.lit(0.0)
            first[f"moments{i}"] = F.struct(
                F.count(v).cast("double").alias("n"), F.coalesce(F.avg(v), none).alias("mean"),
                F.coalesce(F.var_pop(v) * F.count(v), none).alias("m2"))
            after[f"moments{i}"] = F.reduce(
                F.collect_list(f"moments{i}"),
                F.struct(none.alias("n"), none.alias("mean"), none.alias("m2")), _joined)
    level = rows.withColumn("_g", F.spark_partition_id() % groups).groupBy(*keys, "_g").agg(
        *[c.alias(name) for name, c in first.items()])
    while groups > 1:
        groups = -(-groups // FAN_IN)
        level = level.withColumn("_g", F.col("_g") % groups).groupBy(*keys, "_g").agg(
            *[c.alias(name) for name, c in after.items()])
    return level.drop("_g")


def quantiles(spark: SparkSession, wanted: Sequence[tuple[bytes, Sequence[float]]]
              ) -> list[list[float]]:
    """Quantiles of collected sketches at ranks from 0 to 1."""
    wanted = list(wanted)
    held = [(s, r) for s, r in wanted if r]
    if not held:
        return [[] for _ in wanted]
    one = spark.createDataFrame(
        [tuple(bytearray(s) for s, _ in held)],
        ", ".join(f"s{i} binary" for i in range(len(held))))
    got = iter(one.select(*[
        F.kll_sketch_get_quantile_double(f"s{i}", F.array(*[F.lit(float(x)) for x in r]))
        for i, (_, r) in enumerate(held)]).collect()[0])
    return [list(next(got)) if r else [] for _, r in wanted]
