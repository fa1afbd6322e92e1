"""Exact ranks and tiles against a plain sort, for awkward sizes and heavy ties."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkrisk.operators import profile, rank, sketch


def brute_order(rows):
    def key(r):
        score, digest = r[1], hashlib.md5(str(r[0]).encode()).hexdigest()
        return (score is None, -(score or 0.0), digest, r[0])
    return sorted(rows, key=key)


def frame(spark, scores):
    rows = [(i * 7 + 1, s) for i, s in enumerate(scores)]
    return rows, spark.createDataFrame(rows, "id long, score double")


def scores(kind, n):
    rnd = random.Random(n)
    return {
        "distinct": lambda: [rnd.random() for _ in range(n)],
        "equal": lambda: [1.5] * n,
        "two": lambda: [float(rnd.random() < 0.1) for _ in range(n)],
        "third": lambda: [2.0 if rnd.random() < 0.34 else rnd.random() * 4 for _ in range(n)],
        "nulls": lambda: [None if rnd.random() < 0.4 else float(rnd.randrange(5)) for _ in range(n)],
        "infinite": lambda: [rnd.choice([math.inf, -math.inf, 0.0, rnd.random()])
                             for _ in range(n)],
        "close": lambda: [1.0 + rnd.randrange(4) * 2.0 ** -52 for _ in range(n)],
    }[kind]()


@pytest.mark.parametrize("kind", ["distinct", "equal", "two", "third", "nulls", "close", "infinite"])
@pytest.mark.parametrize("buckets", [4, 64])
def test_global_rank_equals_sort(spark, kind, buckets):
    rows, df = frame(spark, scores(kind, 300))
    want = {r[0]: i + 1 for i, r in enumerate(brute_order(rows))}
    got = rank.global_rank(df, "score", "id", buckets=buckets).collect()
    assert {r["id"]: r["rank"] for r in got} == want


def brute_tiles(rows, rule, tiles=10):
    n, out = len(rows), {}
    for i, r in enumerate(brute_order(rows)):
        if rule == "qcut":
            out[r[0]] = max(1, -(-tiles * i // (n - 1))) if n > 1 else 1
        else:
            size, extra = divmod(n, tiles)
            big = extra * (size + 1)
            out[r[0]] = i // (size + 1) + 1 if i < big else extra + 1 + (i - big) // size
    return out


@pytest.mark.parametrize("rule", ["ntile", "qcut"])
@pytest.mark.parametrize("n,kind", [
    (1, "distinct"), (2, "two"), (9, "equal"), (10, "distinct"), (11, "third"), (23, "two"),
    (91, "nulls"), (250, "equal"), (333, "third")])
def test_tiles_equal_brute_force(spark, rule, n, kind):
    rows, df = frame(spark, scores(kind, n))
    got = rank.assign_tile(df, "score", "id", "tile", rule=rule, buckets=8).collect()
    assert {r["id"]: r["tile"] for r in got} == brute_tiles(rows, rule)


def test_empty_table_has_no_cuts(spark):
    _, df = frame(spark, [])
    assert rank.tile_cuts(df, "score", "id") == []
    assert rank.assign_tile(df, "score", "id", "tile").count() == 0


def test_nan_ranks_like_null(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 0.5), (3, None)], "id long, score double")
    got = {r["id"]: r["rank"] for r in rank.global_rank(df, "score", "id").collect()}
    assert got[2] == 1 and {got[1], got[3]} == {2, 3}


def test_tile_sizes_for_the_published_test_set_size():
    ends = rank.qcut_ends(19_724, 10)
    assert (ends[1], ends[4], 19_724 - ends[4]) == (3945, 9862, 9862)
    assert rank.ntile_ends(19_724, 10)[1] == 3946


def test_ntile_sizes_differ_by_one_at_most():
    for n in range(1, 60):
        ends = [0, *rank.ntile_ends(n, 10), n]
        sizes = [b - a for a, b in zip(ends, ends[1:])]
        assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
        assert sizes == sorted(sizes, reverse=True)


def test_hot_value_is_split_into_parts(spark):
    rows, df = frame(spark, scores("third", 4000))
    grid = rank.score_grid(df, "score", 64)
    bucketed = rank.with_bucket(df, "score", "id", grid)
    sizes = [r["count"] for r in bucketed.groupBy("_bucket", "_part").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 4000 / 16


def test_gains_add_up_and_lift(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.random(), int(rnd.random() < 0.3)) for i in range(997)]
    df = spark.createDataFrame(rows, "id long, score double, y int")
    gains = rank.gains_table(df, "score", "y", "id").collect()
    assert sum(r["n_encounters"] for r in gains) == 997
    assert sum(r["n_readmissions"] for r in gains) == sum(r[2] for r in rows)
    assert abs(sum(r["pct_of_all_readmissions_captured"] for r in gains) - 100) < 0.06
    running = rank.cumulative_gains(rank.gains_table(df, "score", "y", "id")).collect()
    assert running[-1]["cum_pct_captured"] == 100.0 and running[-1]["cum_encounters"] == 997
    top = brute_tiles([(r[0], r[1]) for r in rows], "qcut")
    y = {r[0]: r[2] for r in rows}
    first = [y[i] for i, t in top.items() if t == 1]
    want = (sum(first) / len(first)) / (sum(y.values()) / len(y))
    assert rank.top_decile_lift(df, "score", "y", "id").first()["lift_vs_random"] == pytest.approx(
        want, abs=1e-6)


def test_top_k_sample_and_extremes(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "id long, s double")
    best = rank.ranked_top_k(df, [F.desc("s"), F.asc("id")], 3).collect()
    assert [tuple(r) for r in best] == [(1, 4, 4.0), (2, 9, 4.0), (3, 14, 4.0)]
    sample = rank.sample_n(df, 7, 1, "id")
    assert sample.count() == 7 and rank.sample_n(df, 99, 1, "id").count() == 20
    assert sorted(r["id"] for r in sample.collect()) == sorted(
        r["id"] for r in rank.sample_n(df.repartition(3), 7, 1, "id").collect())
    ends = rank.score_extremes(df, "s", "id").first()
    assert (ends["lowest_id"], ends["highest_id"]) == (0, 4)


def test_deciles_shuffle_no_rows(spark):
    _, df = frame(spark, scores("third", 500))
    tiled = rank.assign_tile(df, "score", "id", "tile")
    plan = tiled._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan


def _aggregates(df):
    """Lines of the plan that make or merge sketches."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Aggregate" in line and "kll" in line]


def test_sketches_are_merged_in_a_tree(spark, monkeypatch):
    """Every sketch aggregate has keys, with a fan-in that does not grow with the partitions."""
    made = []
    tree = sketch.sketch_tree

    def recorded(*args, **kwargs):
        made.append(tree(*args, **kwargs))
        return made[-1]

    monkeypatch.setattr(sketch, "sketch_tree", recorded)
    df = spark.range(5000).selectExpr("id", "id % 97 AS score", "id * 0.5 AS other").repartition(40)
    profile.describe_numeric(df, ["score", "other"]).collect()
    profile.iqr_outliers(df, ["score"]).collect()
    rank.global_rank(df, "score", "id").collect()
    assert len(made) == 3
    for frame in made:
        lines = _aggregates(frame)
        assert len(lines) >= 4 and all("keys=[_g" in line for line in lines)
        assert "percentile" not in frame._jdf.queryExecution().executedPlan().toString()


def test_groups_follow_the_shuffle_partitions(spark):
    df = spark.range(1000).selectExpr("cast(id AS double) AS v")
    held = spark.conf.get("spark.sql.shuffle.partitions")
    rounds = {}
    try:
        for partitions in (4, 40, 600):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rounds[partitions] = len(_aggregates(sketch.sketch_tree(df, ["v"], 200)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)
    assert rounds == {4: 4, 40: 6, 600: 8}  # two lines a round: before and after the exchange


def test_sketch_tree_moments_and_keys(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), rnd.choice([None, float("nan"), rnd.gauss(1e6, 1)])) for _ in range(900)]
    rows += [("none", None)] * 5
    df = spark.createDataFrame(rows, "k string, v double").repartition(30).selectExpr(
        "k", "nanvl(v, cast(null AS double)) AS v")
    got = {r["k"]: r for r in sketch.sketch_tree(df, ["v"], 200, ["k"], moments=True).collect()}
    for k in "abc":
        own = [v for key, v in rows if key == k and v is not None and v == v]
        r = got[k]
        assert (r["rows"], r["n0"]) == (sum(key == k for key, _ in rows), len(own))
        assert (r["low0"], r["high0"]) == (min(own), max(own))
        mean = sum(own) / len(own)
        assert r["moments0"]["mean"] == pytest.approx(mean, rel=1e-12)
        assert r["moments0"]["m2"] == pytest.approx(sum((v - mean) ** 2 for v in own), rel=1e-9)
    assert (got["none"]["rows"], got["none"]["n0"], got["none"]["low0"]) == (5, 0, None)
    assert sketch.quantiles(spark, [(got["a"]["s0"], []), (got["a"]["s0"], [0.0, 1.0])]) == [
        [], [got["a"]["low0"], got["a"]["high0"]]]
