"""SimHash near-dedup with deletion-variant signatures.

Two fingerprints at distance at most k, cut into floor(k/2)+1 segments, have a segment in
which they differ by at most one bit. Every distinct fingerprint is indexed under each
segment as it is and under each one-wildcard variant of it (position, segment without that
bit); fingerprints that share a key are joined on it and verified by their full distance.

A key shared by more than ``dense`` fingerprints is not joined with itself. Its members are
indexed a second time, under every word within k/2 bits (k even): two fingerprints are
within k bits exactly when they share such a word, so the members of a word are linked to
its smallest one and no pairs are enumerated. Every pair within k bits shares some key,
either a small one or a dense one, so no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import attach, components, numbered, spare
from sparkrisk.workspace import written

SHINGLE = 3
MAX_BITS = 2
SEED = 42
DENSE = 32
BITS = 64
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of one text; a text without words has 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(grams), _BLOCK):
        hashes = np.array([xxhash.xxh64_intdigest(g, SEED) for g in grams[at:at + _BLOCK]],
                          dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(
            axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(grams)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    @F.pandas_udf("long")
    def simhash(text: pd.Series) -> pd.Series:
        signed = np.array([fingerprint(t, shingle) for t in text], dtype=np.uint64)
        return pd.Series(signed.view(np.int64))

    return docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp"))


def _variants(prints: DataFrame, segments: int) -> DataFrame:
    """Rows (key, fp): each segment as it is and with one bit left out."""
    width = -(-BITS // segments)
    keys = [
        f"transform(sequence(0, {wide}), p -> shiftleft({n}L, 58) | shiftleft(cast(p AS bigint), 51)"
        f" | (cut & ~shiftleft(1L, p)))".replace(
            "cut", f"(shiftrightunsigned(fp, {n * width}) & {(1 << wide) - 1}L)")
        for n in range(segments) if (wide := min(width, BITS - n * width))]
    return prints.select("fp", F.explode(F.expr(f"concat({', '.join(keys)})")).alias("key"))


def _within(prints: DataFrame, radius: int) -> DataFrame:
    """Rows (word, fp): every word within ``radius`` bits of a fingerprint."""
    flips = [sum(1 << b for b in bits) for r in range(radius + 1)
             for bits in combinations(range(BITS), r)]
    signed = ", ".join(f"{m - (1 << BITS) if m >> 63 else m}L".replace(
        "-9223372036854775808L", "shiftleft(1L, 63)") for m in flips)
    return prints.select("fp", F.expr(f"explode(transform(array({signed}), m -> fp ^ m))")
                         .alias("word"))


def links(prints: DataFrame, max_bits: int = MAX_BITS, dense: int = DENSE) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs within ``max_bits``.

    ``prints`` has one row per distinct ``fp``. ``max_bits`` is even, 2 to 46.
    """
    if max_bits % 2 or not 2 <= max_bits < 48:
        raise ValueError("max_bits must be even, from 2 to 46")
    index = _variants(prints, max_bits // 2 + 1)
    sizes = written(index.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"),
                    "keys")
    # the same plan at every size: a merge join, whose hot keys Spark splits
    shared = written(index.join(sizes.hint("merge"), "key"), "shared-keys")
    small = shared.where(F.col("size") <= dense)
    left = small.select("key", F.col("fp").alias("a"))
    right = small.select("key", F.col("fp").alias("b"))
    pairs = (left.join(right, "key").where("a < b").select("a", "b")
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct())
    crowd = shared.where(F.col("size") > dense).select("fp").distinct()
    words = _within(crowd, max_bits // 2)
    centres = (words.groupBy("word").agg(F.min("fp").alias("a"), F.count("*").alias("size"))
               .where("size > 1"))
    stars = words.join(centres, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(stars.distinct())


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, max_bits: int = MAX_BITS,
               dense: int = DENSE) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id reachable over fingerprints that differ in at most
    ``max_bits`` bits, the row's own included. Null and empty texts and texts without a word
    have fingerprint zero and are linked like any other. Null ids are never the smallest
    unless a component has no other. An empty table gives no rows.
    """
    rows = numbered(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fp"), max_bits, dense))
    member = (prints.join(roots, prints["fp"] == roots["node"], "left")
              .select("fp", "least", F.coalesce("root", "fp").alias("root")))
    member = written(member, "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = attach(member.withColumn("run", F.pmod(F.xxhash64("fp"), F.lit(997))),
                   named, ["root"]).select("fp", "component_id")
    return attach(rows, found, ["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        "rid")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component stays: that with the smallest id.

    Rows that repeat that id all stay. Of rows with a null id none stays where the component
    has an id, else all.
    """
    name = spare(docs, "_kept")
    kept = (near_dedup(docs, id_col, text_col, shingle, max_bits)
            .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select(F.col("doc_id").alias(name)).distinct())
    return docs.join(kept, F.col(id_col).eqNullSafe(F.col(name)), "left_semi")


def op2_simhash(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_dedup(docs).drop("rid")
