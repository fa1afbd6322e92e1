"""Exact dedup: tree-merge of sorted digest runs.

Every input partition is a run of (digest, smallest identifier, count) rows in digest
order. In each round ``fan_in`` neighbouring runs meet and are merged: the exchange deals
rows by (group of runs, slice of the digest space), Spark's sort merges the runs, and a
sorted aggregate keeps the smallest identifier of each digest. A digest is the SHA-256 of
the normalised text; byte length and a second hash travel with it and are compared at every
level, so a collision of SHA-256 alone would not unite two texts. After the last round one
run is left per slice, and the decision goes down the same tree to the rows: a text that
holds a third of all rows is at most ``fan_in`` rows per group at every level and at most
the rows of one input partition at the bottom.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkrisk.llm.common import numbered, spare, text_of
from sparkrisk.workspace import written

FAN_IN_BITS = 3
VERIFIED = ["sha", "n_bytes", "second"]


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; ends are not trimmed."""
    # a lone space stays as it is, so only other runs are matched
    return F.regexp_replace(
        text, "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+", " ")


def _with_digest(docs: DataFrame, text_col: str) -> DataFrame:
    plain = normalised(text_of(text_col))
    return docs.withColumns({
        "sha": F.unhex(F.sha2(plain, 256)), "n_bytes": F.octet_length(plain),
        "second": F.xxhash64(plain)})


def _merged(runs: DataFrame, parts: int) -> DataFrame:
    """Runs of the same group merged: one row per verified digest, smallest first row kept."""
    order = ["group", "slice", *VERIFIED]
    return (runs.withColumn("slice", F.substring(F.hex("sha"), 1, 4))
            .repartition(parts, "group", "slice").sortWithinPartitions(*order)
            .groupBy(*order).agg(F.min("first").alias("first"), F.sum("n").alias("n"))
            .drop("slice"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after ``normalised``; null counts as empty. Of equal
    texts the row with the smallest id stays; null ids come after all others, and of rows
    with the same id and text exactly one has ``kept``. An empty table gives no rows.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(_with_digest(docs.select(F.col(id_col).alias("doc_id"),
                                             F.col(text_col).alias("text")), "text")
                    .drop("text"), "digests")
    first = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "rid")
    levels = [written(_merged(rows.select(
        F.col("run").alias("group"), *VERIFIED, first.alias("first"),
        F.lit(1).cast("long").alias("n")), parts), "run-0")]
    top = levels[0].agg(F.max("group")).first()[0] or 0
    while top:
        top >>= fan_in_bits
        up = levels[-1].withColumn("group", F.shiftright("group", fan_in_bits))
        levels.append(written(_merged(up, parts), f"run-{len(levels)}"))

    # down the tree: every run learns the root's decision from the group it was merged into
    known = levels.pop()
    while levels:
        below = levels.pop().select("group", *VERIFIED).withColumn(
            "parent", F.shiftright("group", fan_in_bits))
        known = below.join(known.withColumnRenamed("group", "parent"),
                           ["parent", *VERIFIED]).drop("parent")
    out = rows.join(known.withColumnRenamed("group", "run"), ["run", *VERIFIED])
    return out.select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("rid") == F.col("first.rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``exact_dedup`` keeps, with all their columns.

    Texts travel once: join and window ask for the same partitioning.
    """
    ident, sha, own_id, own_sha, nth = (
        spare(docs, f"_{x}") for x in ("id", "sha", "own_id", "own_sha", "nth"))

    def never_null(name: str) -> Column:
        return F.coalesce(F.concat(F.lit("i"), F.col(name).cast("string")), F.lit(""))

    kept = exact_dedup(docs, id_col, text_col).where("kept").select(
        never_null("doc_id").alias(ident), F.col("text_sha256").alias(sha))
    marked = docs.withColumns({
        own_id: never_null(id_col),
        # never null either: else the join's null filter computes every digest once more
        own_sha: F.coalesce(F.sha2(normalised(text_of(text_col)), 256), F.lit(""))})
    met = marked.join(kept, (F.col(own_id) == F.col(ident)) & (F.col(own_sha) == F.col(sha)))
    # rows that repeat an id and its text: one of them
    once = Window.partitionBy(own_id, own_sha).orderBy(own_id)
    return (met.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
            .select(*docs.columns))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
  FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body)
"""
