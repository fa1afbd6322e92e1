"""Exact global ranks, deciles and gains without a one-task window.

A window without partition keys moves the whole table into one task. Here the score
range is split into many small buckets instead:

1. a quantile sketch of the score, merged in a tree, gives bucket bounds; how many follows
   the number of rows. A value that fills several
   quantiles on its own becomes a bucket of its own, split further by the md5 of the
   row id into as many parts as it filled quantiles;
2. a count per bucket and its running total give the number of rows before each bucket;
3. only inside a bucket are rows ordered.

Any bounds give exact results: they decide how even the buckets are, not the ranks.
The order is (score descending, md5 of the id, id); null scores come last.

Deciles need even less. They are fixed by the rows that sit exactly at the decile ends
(:func:`tile_cuts`); those few rows are found inside at most ``tiles - 1`` buckets, and
every row then gets its decile by comparison with them, with no shuffle at all.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkrisk.functions import as_column, flag_ge, hash32, rate_pct
from sparkrisk.operators import sketch

#: rows that one task should order
ROWS_PER_BUCKET = 1_000_000
#: a sketch of size k tells some k / 4 buckets apart
GRID_K = 8192


@dataclass(frozen=True)
class Grid:
    """Ascending score bounds; ``parts[i]`` is the number of parts of bound ``i``.

    Rows without a score are one more value, dealt into ``null_parts`` parts.
    """

    rows: int
    bounds: tuple[float, ...]
    parts: tuple[int, ...]
    null_parts: int = 1


@dataclass(frozen=True)
class Cut:
    """The last row of a tile."""

    score: float | None
    digest: str
    id: object


def default_buckets(df: DataFrame, rows: int = 0) -> int:
    """One bucket per ``ROWS_PER_BUCKET`` rows, and at least four per shuffle partition."""
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(128, 4 * partitions, -(-rows // ROWS_PER_BUCKET))


def _array(values, of: str) -> Column:
    """A constant array built from one text literal (folded by the optimizer)."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{of}>")


def _clean_score(score: str) -> Column:
    """The score as a double, NaN taken as null."""
    return F.nanvl(as_column(score).cast("double"), F.lit(None).cast("double"))


def score_grid(df: DataFrame, score: str, buckets: int | None = None) -> Grid:
    """Bounds from a quantile sketch; at most ``buckets`` numbers reach the driver."""
    return score_grids(df, score, None, buckets).get(None, Grid(0, (), ()))


def score_grids(df: DataFrame, score: str, by: str | None,
                buckets: int | None = None) -> dict[object, Grid]:
    """The grid of each group ``by``, of which there are a few; one of all rows without it.

    Bounds need not be exact. Very many rows need more buckets than the sketch tells apart:
    then it is made once more, as large as it needs to be (up to 16,384 buckets).
    """
    keys = [] if by is None else ["_by"]
    rows = df.select(_clean_score(score).alias("_v"),
                     *[as_column(by).alias("_by") for _ in keys])
    k = GRID_K
    while True:
        found = sketch.sketch_tree(rows, ["_v"], k, keys).collect()
        wanted = [buckets or default_buckets(df, r["rows"]) for r in found]
        if k >= min(sketch.MOST_K, max((4 * w for w in wanted), default=0)):
            break
        k = sketch.MOST_K
    wanted = [min(w, k // 4) for w in wanted]
    bounds = sketch.quantiles(df.sparkSession, [
        (r["s0"], [i / w for i in range(1, w)] if r["n0"] else [])
        for r, w in zip(found, wanted, strict=True)])
    grids = {}
    for r, w, own in zip(found, wanted, bounds, strict=True):
        counts = Counter(sorted(own))
        n, known = r["rows"], r["n0"]
        grids[r["_by"] if keys else None] = Grid(
            n, tuple(counts), tuple(counts.values()), max(1, -(-(n - known) * w // max(1, n))))
    return grids


def _slots(grid: Grid) -> tuple[list[float], list[int]]:
    """Ascending edges of the slots, and the number of parts of each.

    Each bound opens a slot for itself alone and one for the values above it, up to the
    next bound.
    """
    edges, parts = [float("-inf")], [1]
    for bound, times in zip(grid.bounds, grid.parts):
        if bound == math.inf:           # stays in the slot above the bound before
            continue
        if edges[-1] == bound:          # the slot above the last bound is empty
            parts[-1] = times
        else:
            edges.append(bound)
            parts.append(times)
        above = math.nextafter(bound, math.inf)
        if math.isfinite(above):
            edges.append(above)
            parts.append(1)
    return [*edges, float("inf")], parts


def with_bucket(df: DataFrame, score: str, id: str | None, grid: Grid) -> DataFrame:
    """Add ``_score``, ``_bucket`` and ``_part``; ascending (bucket, part) follows the order.

    Both new columns are never null, so joins on them add no null filters.
    """
    return with_buckets(df, score, id, {None: grid})


def with_buckets(df: DataFrame, score: str, id: str | None, grids: dict[object, Grid],
                 by: str | None = None) -> DataFrame:
    """``with_bucket`` by the grid of each row's group ``by``, of which there are a few."""
    rows = df.withColumn("_score", _clean_score(score))
    slot, share = F.lit(None).cast("int"), F.lit(1).cast("long")
    for i, (name, grid) in enumerate(grids.items()):
        edges, parts = _slots(grid)
        own = F.lit(True) if by is None else as_column(by) == F.lit(name)
        rows = rows.withColumn(f"_s{i}", F.when(own, F.col("_score")))
        rows = Bucketizer(splits=edges, inputCol=f"_s{i}", outputCol=f"_slot{i}",
                          handleInvalid="keep").transform(rows)
        found = F.col(f"_slot{i}").cast("int")
        slot = F.when(own, found).otherwise(slot)
        share = F.when(own, F.element_at(_array([grid.null_parts, *parts], "long"),
                                         F.coalesce(found, F.lit(-1)) + 2)).otherwise(share)
    rows = rows.withColumn("_slot", F.coalesce(slot, F.lit(-1)))
    part = F.lit(0).cast("long")
    if id is not None:
        part = F.when(share > 1, F.shiftright(hash32(id) * share, 32)).otherwise(part)
    return rows.withColumns({
        "_bucket": -F.col("_slot"), "_part": F.coalesce(part, F.lit(0).cast("long")),
    }).drop("_slot", *[f"{c}{i}" for i in range(len(grids)) for c in ("_s", "_slot")])


def bucket_offsets(bucketed: DataFrame, sums: dict[str, str] | None = None,
                   by: str | None = None) -> DataFrame:
    """One row per bucket part: rows in it (``_n``), rows before it, rows in all.

    ``sums`` replaces the row count by sums of columns, as ``{suffix: column}``; ``by`` counts
    each group on its own. The window runs over the bucket counts only, whose number is
    bounded by the grid.
    """
    keys = [] if by is None else [by]
    aggs = {f"_{s}": F.sum(c) for s, c in sums.items()} if sums else {"_n": F.count(F.lit(1))}
    counts = bucketed.groupBy(*keys, "_bucket", "_part").agg(
        *[c.alias(a) for a, c in aggs.items()])
    order = Window.partitionBy(*keys).orderBy("_bucket", "_part")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = [*keys, "_bucket", "_part", *aggs]
    for a in aggs:
        end = "" if a == "_n" else a
        out += [(F.sum(a).over(upto) - F.col(a)).alias(f"_before{end}"),
                F.sum(a).over(every).alias(f"_total{end}")]
    return counts.select(*out)


def _digest(id: str) -> Column:
    return F.md5(as_column(id).cast("string"))


def _rank_in_bucket(id: str, *by: str) -> Column:
    order = Window.partitionBy(*by, "_bucket", "_part").orderBy(
        F.desc_nulls_last("_score"), _digest(id), as_column(id))
    return F.col("_before") + F.row_number().over(order)


def global_rank(df: DataFrame, score: str, id: str, out: str = "rank",
                buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank of every row, sorted in parallel."""
    bucketed = with_bucket(df, score, id, score_grid(df, score, buckets))
    placed = bucketed.join(F.broadcast(bucket_offsets(bucketed)), ["_bucket", "_part"])
    return placed.withColumn(out, _rank_in_bucket(id)).select(*df.columns, out)


def ntile_ends(n: int, tiles: int) -> list[int]:
    """Last rank of tiles 1..tiles-1 when larger tiles come first."""
    size, extra = divmod(n, tiles)
    return [t * size + min(t, extra) for t in range(1, tiles)]


def qcut_ends(n: int, tiles: int) -> list[int]:
    """Last rank of tiles 1..tiles-1 when ranks are cut at linear quantiles."""
    return [1 + t * (n - 1) // tiles for t in range(1, tiles)]


TILE_RULES = {"ntile": ntile_ends, "qcut": qcut_ends}


def tile_cuts(df: DataFrame, score: str, id: str, tiles: int = 10, rule: str = "ntile",
              buckets: int | None = None, first: int | None = None,
              grid: Grid | None = None) -> list[Cut]:
    """The rows at the tile ends (or the ``first`` few): at most ``tiles - 1`` rows
    reach the driver. ``grid`` may be given if it is known already."""
    rows = df.select(as_column(score).alias("_s"), as_column(id).alias("_id"))
    grid = grid or score_grid(rows, "_s", buckets)
    if grid.rows == 0:
        return []
    bucketed = with_bucket(rows, "_s", "_id", grid)
    ends = TILE_RULES[rule](grid.rows, tiles)[:first]
    holds_end = F.exists(F.lit(ends), lambda e: (e > F.col("_before"))
                         & (e <= F.col("_before") + F.col("_n")))
    needed = bucket_offsets(bucketed).filter(holds_end)
    near = bucketed.join(F.broadcast(needed), ["_bucket", "_part"])
    found = (
        near.withColumn("_rank", _rank_in_bucket("_id"))
        .filter(F.col("_rank").isin(*sorted(set(ends))))
        .select("_rank", "_score", _digest("_id").alias("_digest"), "_id").collect()
    )
    by_rank = {r["_rank"]: Cut(r["_score"], r["_digest"], r["_id"]) for r in found}
    return [by_rank[e] for e in ends]


def group_cuts(df: DataFrame, score: str, id: str, by: str, grids: dict[object, Grid],
               tiles: int = 10, rule: str = "ntile") -> dict[object, Cut]:
    """The last row of the first tile of each group: one row per group reaches the driver."""
    ends = {name: TILE_RULES[rule](grid.rows, tiles)[0] for name, grid in grids.items()}
    rows = df.select(as_column(score).alias("_s"), as_column(id).alias("_id"),
                     as_column(by).alias("_by"))
    bucketed = with_buckets(rows, "_s", "_id", grids, "_by")
    end = F.lit(None).cast("long")
    for name, place in ends.items():
        end = F.when(F.col("_by") == F.lit(name), place).otherwise(end)
    needed = bucket_offsets(bucketed, by="_by").filter(
        (end > F.col("_before")) & (end <= F.col("_before") + F.col("_n")))
    near = bucketed.join(F.broadcast(needed), ["_by", "_bucket", "_part"])  # one per group
    found = near.withColumn("_rank", _rank_in_bucket("_id", "_by")).filter(
        F.col("_rank") == end).select("_by", "_score", _digest("_id").alias("_digest"), "_id")
    return {r["_by"]: Cut(r["_score"], r["_digest"], r["_id"]) for r in found.collect()}


def in_first_tile(score: str, id: str, by: str, cuts: dict[object, Cut]) -> Column:
    """Whether a row is in the first tile of its group."""
    value, first = _clean_score(score), F.lit(None).cast("boolean")
    for name, cut in cuts.items():
        first = F.when(as_column(by) == F.lit(name), ~_after(value, id, cut)).otherwise(first)
    return F.coalesce(first, F.lit(False))


def _after(score: Column, id: str, end: Cut) -> Column:
    """True for rows that come after the given row in the global order."""
    digest = _digest(id)
    tied_after = (digest > end.digest) | ((digest == end.digest) & (as_column(id) > F.lit(end.id)))
    if end.score is None:
        return score.isNull() & tied_after
    return score.isNull() | (score < F.lit(end.score)) | (
        (score == F.lit(end.score)) & tied_after)


def tile_of(score: str, id: str, cuts: list[Cut]) -> Column:
    """Tile number of a row, a plain expression over the cut rows."""
    value = _clean_score(score)
    tile = F.lit(1)
    for end in cuts:
        tile = tile + F.when(_after(value, id, end), 1).otherwise(0)
    return tile.cast("int")


def assign_tile(df: DataFrame, score: str, id: str, out: str, tiles: int = 10,
                rule: str = "ntile", buckets: int | None = None) -> DataFrame:
    """Add the tile number of every row; no row of ``df`` is shuffled."""
    return df.withColumn(out, tile_of(score, id, tile_cuts(df, score, id, tiles, rule, buckets)))


def gains_table(df: DataFrame, score: str, label: str, id: str, tiles: int = 10,
                rule: str = "ntile") -> DataFrame:
    """Rows, positives, rate and share of all positives per tile of the score."""
    tiled = assign_tile(df, score, id, "risk_decile", tiles, rule)
    return gains_of(tiled, "risk_decile", label)


def gains_of(tiled: DataFrame, tile: str, label: str) -> DataFrame:
    """Gains table of a table that already has its tiles."""
    grouped = tiled.groupBy(as_column(tile).alias("risk_decile")).agg(
        F.count(F.lit(1)).alias("n_encounters"),
        F.coalesce(F.sum(as_column(label)).cast("long"), F.lit(0)).alias("n_readmissions"))
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return grouped.select(
        "risk_decile", "n_encounters", "n_readmissions",
        rate_pct("n_readmissions", "n_encounters").alias("readmit_rate_pct"),
        rate_pct("n_readmissions", F.sum("n_readmissions").over(every))
        .alias("pct_of_all_readmissions_captured")).orderBy("risk_decile")


def cumulative_gains(gains: DataFrame) -> DataFrame:
    """Running share of positives captured; ``gains`` has one row per tile."""
    running = Window.orderBy("risk_decile").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return gains.select(
        "risk_decile",
        F.sum("n_encounters").over(running).alias("cum_encounters"),
        F.sum("n_readmissions").over(running).alias("cum_readmissions"),
        rate_pct(F.sum("n_readmissions").over(running), F.sum("n_readmissions").over(every))
        .alias("cum_pct_captured")).orderBy("risk_decile")


def top_tile_measures(in_top: Column, label: str) -> list[Column]:
    """Aggregates behind lift and capture of a chosen part of the table."""
    y = as_column(label)
    return [F.count(F.lit(1)).alias("_n"),
            F.coalesce(F.sum(y).cast("long"), F.lit(0)).alias("_pos"),
            F.count_if(in_top).alias("_top_n"),
            F.coalesce(F.sum(F.when(in_top, y)).cast("long"), F.lit(0)).alias("_top_pos")]


def _lift() -> Column:
    top = F.try_divide(F.col("_top_pos").cast("double"), F.col("_top_n").cast("double"))
    base = F.try_divide(F.col("_pos").cast("double"), F.col("_n").cast("double"))
    return F.try_divide(top, base)


def lift_columns() -> list[Column]:
    """Rate in the chosen part, share of positives it captures, and lift over average."""
    return [rate_pct("_top_pos", "_top_n").alias("top_decile_readmit_rate_pct"),
            rate_pct("_top_pos", "_pos").alias("pct_of_readmissions_captured"),
            F.round(_lift(), 6).alias("lift_vs_random")]


def lift_of(df: DataFrame, in_top: Column, label: str) -> DataFrame:
    """The three measures of a chosen part of the table."""
    return df.agg(*top_tile_measures(in_top, label)).select(*lift_columns())


def top_decile_lift(df: DataFrame, score: str, label: str, id: str, tiles: int = 10,
                    grid: Grid | None = None) -> DataFrame:
    """Rate, capture and lift of the first quantile tile of the score."""
    cuts = tile_cuts(df, score, id, tiles, "qcut", first=1, grid=grid)
    return lift_of(df, tile_of(score, id, cuts) == 1, label)


def rule_flag_lift(df: DataFrame, col: str, threshold: int, label: str) -> DataFrame:
    """The same three measures for a plain threshold rule."""
    return lift_of(df, flag_ge(col, threshold) == 1, label)


def lift_measures(tiled: DataFrame, tile: str, label: str) -> DataFrame:
    """Lift of the first tile and share of positives in the first two."""
    first = tiled.agg(
        *top_tile_measures(as_column(tile) == 1, label),
        F.coalesce(F.sum(F.when(as_column(tile) <= 2, as_column(label))).cast("long"),
                   F.lit(0)).alias("_top2_pos"))
    zero = F.lit(0.0)
    return first.select(
        F.round(F.coalesce(_lift(), zero), 6).alias("top_decile_lift"),
        F.round(F.coalesce(F.try_divide(F.col("_top2_pos").cast("double"),
                                        F.col("_pos").cast("double")), zero), 6)
        .alias("captured_top_two"))


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows; Spark keeps only ``k`` rows per task."""
    return df.orderBy(*order).limit(k)


def ranked_top_k(df: DataFrame, order: list[Column], k: int,
                 out: str = "priority_rank") -> DataFrame:
    """Top ``k`` rows with their place as the first column; the window sees ``k`` rows."""
    best = top_k(df, order, k)
    place = F.row_number().over(Window.orderBy(*order)).alias(out)
    return best.select(place, *[as_column(c) for c in df.columns]).orderBy(out)


def with_place(df: DataFrame, out: str = "place") -> DataFrame:
    """A small ordered result with the place of each row, from 1, as its first column."""
    one = df.coalesce(1)
    return one.select((F.monotonically_increasing_id() + 1).cast("int").alias(out), *[
        as_column(c) for c in df.columns])


def sample_n(df: DataFrame, n: int, seed: int, id: str) -> DataFrame:
    """Exactly ``min(n, rows)`` rows, chosen by the md5 of seed and id."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), as_column(id).cast("string")))
    return df.orderBy(digest, as_column(id)).limit(n)


def score_extremes(df: DataFrame, score: str, id: str) -> DataFrame:
    """Lowest, mean and highest score and the rows that hold the ends (smallest id on ties).

    Rows with a null or NaN score hold no end.
    """
    s, key = _clean_score(score), as_column(id)
    return df.agg(
        F.min(s).alias("min_score"), F.round(F.avg(s), 6).alias("avg_score"),
        F.max(s).alias("max_score"),
        F.min_by(key, F.when(s.isNotNull(), F.struct(s, key))).alias("lowest_id"),
        F.min_by(key, F.when(s.isNotNull(), F.struct(-s, key))).alias("highest_id"))
