"""Helpers shared by the corpus operators.

Operators take the columns they need by name and give every output column a name of its
own, so further columns of the input, whatever they are called, never get in the way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrisk.workspace import written

#: edges that one task contracts at a time
EDGES = 1_000_000
DOCUMENT_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spare(df: DataFrame, name: str) -> str:
    """``name``, or a longer one if ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def text_of(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` written with ``run`` (the partition a row came from) and ``rid`` (a row number).

    Both are fixed by the written table, so later jobs agree on them even if they run again.
    """
    return written(df.withColumns({
        "run": F.spark_partition_id(), "rid": F.monotonically_increasing_id()}), name)


def attach(rows: DataFrame, lookup: DataFrame, keys: list[str], run: str = "run",
           how: str = "left") -> DataFrame:
    """Join rows to a lookup with one row per key, however many rows a key has.

    The lookup is first joined to the distinct (key, run) pairs, so a hot key costs one row
    per run there; the rows then meet it on (key, run), which splits the hot key by run.
    """
    held = rows.select(*keys, run).distinct().join(lookup, keys)
    return rows.join(held, [*keys, run], how)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of every node that is not the smallest of its component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    label = np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars around the smallest nodes, ``EDGES`` at a time."""
    def solved(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("u", "v")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in forest(*ends)], names=["u", "v"])

    parts, n = [], 0
    for batch in batches:
        parts.append(batch)
        n += batch.num_rows
        if n >= EDGES:
            yield solved(parts)
            parts, n = [], 0
    if parts:
        yield solved(parts)


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, root), root the smallest.

    Edges are dealt into lots of about ``most``, and every lot is contracted to stars around its
    smallest nodes by one task. If there is more than one lot, large-star and small-star rounds
    follow, each after a contraction, until a round leaves the edge set as it was. Every round
    is written to the shared folder. A node with very many neighbours, as the root of a large
    component is, meets its smallest one through ``attach``, so its edges stay dealt over the
    runs they were read in. Nodes without an edge are not in the result. No edges: no rows.
    """
    def contracted(pairs: DataFrame, n: int) -> DataFrame:
        return pairs.repartition(-(-n // most)).mapInArrow(_contracted, "u long, v long")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        # (u, v): neighbours v of u; large: all of them, small: the smaller ones
        pairs = pairs.withColumn("run", F.spark_partition_id())
        if large:
            near = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"),
                                                  "run"))
        else:
            near = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"),
                                "run")
        least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = attach(near, least, ["u"])
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
                least.select("u", F.col("m").alias("v")))
        return out.where("u <> v").distinct()

    def mark(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
                               ).first())

    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                  .where("u <> v").distinct(), "edges")
    before = mark(now)
    if 0 < before[0] <= most:
        now = written(contracted(now, before[0]), "edges")
    else:
        while before[0]:
            now = written(star(star(contracted(now, before[0]), True), False), "edges")
            after = mark(now)
            if after == before:
                break
            before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
