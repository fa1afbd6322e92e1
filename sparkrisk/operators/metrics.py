"""Classification metrics computed exactly on the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrisk.functions import as_column
from sparkrisk.operators import rank
from sparkrisk.operators.rank import Grid, bucket_offsets, score_grids, with_buckets


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def _confusion(label: str, pred: str) -> list[Column]:
    y, p = as_column(label) == 1, as_column(pred) == 1
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
            F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn")]


def _threshold_columns() -> list[Column]:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    return [F.round(_ratio(tp + tn, tp + fp + tn + fn), 6).alias("accuracy"),
            F.round(_ratio(tp, tp + fp), 6).alias("precision"),
            F.round(_ratio(tp, tp + fn), 6).alias("recall"),
            F.round(_ratio(tp * 2, tp * 2 + fp + fn), 6).alias("f1")]


def binary_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Confusion counts, accuracy, precision, recall and F1; 0 where undefined."""
    return df.agg(*_confusion(label, pred)).select("tp", "fp", "tn", "fn", *_threshold_columns())


def _cumulative(df: DataFrame, score: str, label: str, buckets: int | None,
                grids: dict[object, Grid] | None = None, by: str | None = None) -> DataFrame:
    """One row per distinct score, highest first: counts and running counts before it.

    Rows collapse to distinct scores before the shuffle. Running counts are the total of
    the buckets before plus a window inside the bucket, so no task sees all scores. With
    ``by`` each group is counted on its own, in column ``_by``.
    """
    keys = [] if by is None else ["_by"]
    rows = df.select(as_column(score).cast("double").alias("_s"),
                     as_column(label).cast("long").alias("_y"),
                     *[as_column(by).alias("_by") for _ in keys]).filter(
        F.col("_s").isNotNull() & F.col("_y").isNotNull())
    scores = rows.groupBy(*keys, "_s").agg(F.sum("_y").alias("pos"),
                                           F.count(F.lit(1)).alias("n"))
    own = "_by" if keys else None
    bucketed = with_buckets(scores, "_s", None, grids or score_grids(rows, "_s", own, buckets), own)
    starts = bucket_offsets(bucketed, {"rows": "n", "pos": "pos"}, own).drop("_rows", "_pos")
    placed = bucketed.join(F.broadcast(starts), [*keys, "_bucket", "_part"])
    inside = Window.partitionBy(*keys, "_bucket", "_part").orderBy(F.desc("_s")).rowsBetween(
        Window.unboundedPreceding, 0)
    return placed.select(
        *keys, F.col("_s").alias("score"), "n", "pos",
        (F.col("_before_rows") + F.sum("n").over(inside)).alias("n_upto"),
        (F.col("_before_pos") + F.sum("pos").over(inside)).alias("pos_upto"),
        F.col("_total_rows").alias("n_all"), F.col("_total_pos").alias("pos_all"))


def _area(steps: DataFrame, *keys: str) -> DataFrame:
    neg = (F.col("n") - F.col("pos")).cast("double")
    neg_upto = (F.col("n_upto") - F.col("pos_upto")).cast("double")
    neg_all = (F.col("n_all") - F.col("pos_all")).cast("double")
    wins = F.col("pos").cast("double") * (neg_all - neg_upto + neg / 2.0)
    one = steps.groupBy(*keys).agg(F.sum(wins).alias("_u"), F.first("n_all").alias("_n"),
                                   F.first("pos_all").alias("_p"))
    pairs = F.col("_p").cast("double") * (F.col("_n") - F.col("_p")).cast("double")
    return one.select(*keys, F.round(F.try_divide("_u", pairs), 6).alias("roc_auc"))


def roc_auc(df: DataFrame, score: str, label: str, buckets: int | None = None,
            grid: Grid | None = None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; null if a class is missing."""
    return _area(_cumulative(df, score, label, buckets, {None: grid} if grid else None))


def evaluate_by(df: DataFrame, by: str, score: str, label: str, pred: str, id: str,
                tiles: int = 10) -> DataFrame:
    """One row per group ``by`` (a few: models, scores): every measure of a classifier.

    Threshold measures, exact ROC area, and rate, capture and lift of the first quantile tile.
    All groups go through the same passes: one for the grids of all groups, one for the rows at
    the tile ends, one for all counts, and one over distinct scores for the areas. Rows without
    a group belong to none; a group without a positive or without a negative has no area. An id
    is unique within a group.
    """
    rows = df.filter(as_column(by).isNotNull())
    grids = score_grids(rows, score, by)
    if not grids:
        grids = {"": Grid(0, (), ())}
    cuts = rank.group_cuts(rows, score, id, by, grids, tiles, "qcut")
    counted = rows.groupBy(as_column(by).alias("_by")).agg(
        *_confusion(label, pred),
        *rank.top_tile_measures(rank.in_first_tile(score, id, by, cuts), label)).select(
        "_by", *_threshold_columns(), *rank.lift_columns())
    areas = _area(_cumulative(rows, score, label, None, grids, by), "_by")
    # one row per group on both sides
    out = counted.join(F.broadcast(areas), "_by", "left")
    return out.select(F.col("_by").alias(by), "accuracy", "precision", "recall", "f1", "roc_auc",
                      "top_decile_readmit_rate_pct", "pct_of_readmissions_captured",
                      "lift_vs_random")


def roc_curve(df: DataFrame, score: str, label: str, max_points: int | None = None,
              buckets: int | None = None) -> DataFrame:
    """ROC points from the origin (point 0, no threshold) over every distinct score down.

    ``point`` is the number of rows at or above the threshold. ``max_points`` thins the
    curve: the rows are cut into that many equal slices by rank, numbered from 1, and the
    last distinct score that ends in a slice gives its point.
    """
    steps = _cumulative(df, score, label, buckets)
    piece = F.col("n_upto") if max_points is None else F.call_function(
        "div", F.col("n_upto") * max_points + F.col("n_all") - 1, F.col("n_all"))
    last = steps.groupBy(piece.cast("long").alias("point")).agg(
        F.max_by(F.struct("score", "n_upto", "pos_upto", "n_all", "pos_all"), "n_upto")
        .alias("s"))
    neg, neg_all = F.col("s.n_upto") - F.col("s.pos_upto"), F.col("s.n_all") - F.col("s.pos_all")
    points = last.select(
        "point", F.col("s.score").alias("threshold"),
        F.round(_ratio(neg, neg_all), 6).alias("fpr"),
        F.round(_ratio(F.col("s.pos_upto"), F.col("s.pos_all")), 6).alias("tpr"))
    origin = df.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("point"), F.lit(None).cast("double").alias("threshold"),
        F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return origin.unionByName(points).orderBy("point")


def compare_scores(a: DataFrame, b: DataFrame, id: str, score: str) -> DataFrame:
    """Rows on one side only and the largest difference of scores on shared rows."""
    left = a.select(as_column(id).alias("_id"), as_column(score).alias("_a"),
                    F.lit(True).alias("_in_a"))
    right = b.select(as_column(id).alias("_id"), as_column(score).alias("_b"),
                     F.lit(True).alias("_in_b"))
    return left.join(right, "_id", "full").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_in_a").isNull() | F.col("_in_b").isNull()).alias("n_unmatched"),
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff"))


def assert_same_scores(a: DataFrame, b: DataFrame, id: str, score: str,
                       tol: float = 1e-6) -> None:
    """Raise unless two prediction paths agree on the same rows."""
    row = compare_scores(a, b, id, score).first()
    if row["n_unmatched"] or (row["max_diff"] or 0.0) > tol:
        raise ValueError(f"scores differ: {row.asDict()}")
