"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf, the SHA-256 of its length-prefixed fields. The leaves of a group form a
binary tree in key order, the roots of the groups form one more tree in group order. A node is
labelled by (level, place), and every parent has a later label than its children, so a tree is
evaluated in label order: a node is taken from a priority queue together with what its
children have sent it, and sends its own digest on to its parent. The reversed sweep goes
through the same labels backwards: a parent sends each child the rest of its proof.

The queue that spans the whole tree is external, a sorted exchange: ``SLAB`` levels at a time
are one sweep, in which every task reads its blocks of 2^SLAB neighbouring nodes in label order
and keeps a queue for one block only. A tree over n leaves takes log2(n) / SLAB sweeps up and
as many down, whatever the sizes of its groups; a group of a third of all rows is as many
blocks as it needs. Messages from above come as rows that sort in front of their block.

Places come from a range partitioning by (group, key): rows are counted per partition and
group, and numbered inside it.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkrisk.workspace import written

SLAB = 10
DOCUMENT_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEPS = "array<struct<left:string,right:string>>"
_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
ROWS_OUT = 4096


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the fields one after another."""
    return F.sha2(F.concat(*(field(v) for v in values)), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda own, step: F.sha2(
        F.concat(step["left"], own, step["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings of a proof, from the leaf to the root, left to right."""
    return F.sha2(F.array_join(F.transform(
        proof, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def _placed(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with ``idx``, the place in the group ``grp`` by ``order``, and ``total``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("grp"), *(F.col(c).asc_nulls_first() for c in order)]
    cut = written(rows.repartitionByRange(parts, *keys).withColumn(
        "part", F.spark_partition_id()), f"{name}-ranges")
    by_part = Window.partitionBy("grp").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    held = cut.groupBy("grp", "part").agg(F.count("*").alias("n")).select(
        "grp", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("grp")).alias("total"))
    nth = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*keys[1:]))
    return (cut.withColumn("nth", nth).join(held, ["grp", "part"])
            .withColumn("idx", F.col("before") + F.col("nth") - 1)
            .drop("part", "nth", "before"))


def block_tree(digests: list[str], single: bool, levels: int):
    """Digests of the tree over a block, in label order, and where it ends.

    ``nodes[level]`` are the digests of a level. A block that is a whole tree ends at its
    root, any other after ``levels`` levels.
    """
    nodes = [digests]
    queue = [(1, at >> 1, at, digest) for at, digest in enumerate(digests)]
    heapq.heapify(queue)
    counts = [len(digests)]
    while counts[-1] > 1 or not single and len(counts) <= levels:
        counts.append((counts[-1] + 1) // 2)
    top = len(counts) - 1
    while queue and queue[0][0] <= top:
        level, place = queue[0][:2]
        sent = ""
        while queue and queue[0][:2] == (level, place):
            sent += heapq.heappop(queue)[3]
        if len(nodes) == level:
            nodes.append([])
        digest = _sha(sent)
        nodes[level].append(digest)
        heapq.heappush(queue, (level + 1, place >> 1, place, digest))
    return nodes


def block_proofs(nodes: list[list[str]], above: list[tuple[str, str]]) -> list[list]:
    """Proofs of the lowest nodes of a block, whose top has the proof ``above``.

    The labels of ``block_tree`` in reversed order: a node gets its parent's proof from the
    queue and sends its children that proof behind their own step.
    """
    out: list = [None] * len(nodes[0])
    queue: list = [(1 - len(nodes), 0, above)]
    while queue:
        level, place, proof = heapq.heappop(queue)
        if level == 0:
            out[place] = proof
            continue
        below = nodes[-level - 1]
        first = 2 * place
        if first + 1 < len(below):
            heapq.heappush(queue, (level + 1, first, [("", below[first + 1]), *proof]))
            heapq.heappush(queue, (level + 1, first + 1, [(below[first], ""), *proof]))
        else:
            heapq.heappush(queue, (level + 1, first, [("", ""), *proof]))
    return out


def _blocks(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[dict]]:
    """Rows of one (grp, block) after another."""
    rows: list[dict] = []
    for batch in batches:
        for row in batch.select(names).to_pylist():
            if rows and (row["grp"], row["block"]) != (rows[-1]["grp"], rows[-1]["block"]):
                yield rows
                rows = []
            rows.append(row)
    if rows:
        yield rows


def _dealt(rows: DataFrame) -> DataFrame:
    """Blocks in label order, each in one task."""
    return rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "idx")


def _sweep_up(nodes: DataFrame, slab: int) -> DataFrame:
    """The nodes ``slab`` levels higher; trees that end lower give their root."""
    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([
                pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()),
                pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64())],
                names=["grp", "idx", "digest", "total"])

        for rows in _blocks(batches, ["grp", "block", "digest", "total"]):
            total = rows[0]["total"]
            single = total <= 1 << slab
            tree = block_tree([r["digest"] for r in rows], single, slab)
            out.append((rows[0]["grp"], rows[0]["block"], tree[-1][0],
                        1 if single else -(-total >> slab)))
            if len(out) >= ROWS_OUT:
                yield flushed()
                out.clear()
        yield flushed()

    return _dealt(nodes.withColumn("block", F.shiftright("idx", slab)).select(
        "grp", "block", "idx", "digest", "total")).mapInArrow(
        up, "grp string, idx long, digest string, total long")


def _sweep_down(nodes: DataFrame, above: DataFrame, slab: int) -> DataFrame:
    """``nodes`` with their proofs, from the proofs of the nodes ``slab`` levels higher.

    ``above``: grp, idx, proof, subroot, root. What else ``nodes`` has is carried along.
    """
    carried = [c for c in nodes.columns if c not in ("grp", "idx", "digest", "total")]
    kinds = dict(nodes.dtypes)
    message = above.select(
        "grp", F.col("idx").alias("block"), F.lit(-1).cast("long").alias("idx"),
        F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("total"),
        "proof", "subroot", "root",
        *[F.lit(None).cast(kinds[c]).alias(c) for c in carried])
    own = nodes.withColumn("block", F.shiftright("idx", slab)).select(
        "grp", "block", "idx", "digest", "total", F.lit(None).cast(STEPS).alias("proof"),
        F.lit(None).cast("string").alias("subroot"), F.lit(None).cast("string").alias("root"),
        *carried)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        proofs: list[list] = []
        types: dict = {}

        def flushed() -> pa.RecordBatch:
            flat = [step for proof in proofs for step in proof]
            offsets = [0]
            for proof in proofs:
                offsets.append(offsets[-1] + len(proof))
            steps = pa.StructArray.from_arrays(
                [pa.array([s[0] for s in flat], pa.string()),
                 pa.array([s[1] for s in flat], pa.string())], fields=list(_STEP))
            names = ["grp", "idx", "digest", "subroot", "root", *carried]
            return pa.RecordBatch.from_arrays(
                [*(pa.array([r[c] for r in out], types[c]) for c in names),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps)],
                names=[*names, "proof"])

        def typed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types.update(zip(batch.schema.names, batch.schema.types, strict=True))
                yield batch

        for rows in _blocks(typed(batches), ["grp", "block", "idx", "digest", "total", "proof",
                                             "subroot", "root", *carried]):
            sent, rows = rows[0], rows[1:]
            tree = block_tree([r["digest"] for r in rows], rows[0]["total"] <= 1 << slab, slab)
            above = [(s["left"], s["right"]) for s in sent["proof"]]
            for row, proof in zip(rows, block_proofs(tree, above), strict=True):
                out.append(row | {"subroot": sent["subroot"], "root": sent["root"]})
                proofs.append(proof)
            if len(out) >= ROWS_OUT:
                yield flushed()
                out.clear()
                proofs.clear()
        if out:
            yield flushed()

    more = "".join(f", `{c}` {kinds[c]}" for c in carried)
    return _dealt(own.unionByName(message)).mapInArrow(
        down, f"grp string, idx long, digest string, subroot string, root string{more},"
              f" proof {STEPS}")


def _roots(nodes: DataFrame, slab: int, name: str) -> list[DataFrame]:
    """``nodes`` and the tables of nodes above them, up to one root per group."""
    levels = [nodes]
    while (levels[-1].agg(F.max("total")).first()[0] or 0) > 1:
        levels.append(written(_sweep_up(levels[-1], slab), f"{name}-up"))
    return levels


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang",
             value_cols: tuple[str, ...] = DOCUMENT_COLUMNS,
             carry: dict[str, Column] | None = None, slab: int = SLAB) -> DataFrame:
    """One row per input row: doc_id, leaf, subroot, root, proof.

    A leaf is the digest of ``value_cols``. The leaves of a group are in the order of their ids
    (null first), equal ids in the order of their digests; groups are in bytewise order, null
    first. Two neighbours at a time become the digest of both, a last one alone the digest of
    itself, until one is left. A proof has one step per level, the digests left and right of
    the own one (empty if there is none), first in the group's tree, then in the tree of
    groups; ``fold`` leads from a leaf to the root. Null values, null groups, empty and long
    texts are values like any other; repeated rows are leaves of their own. ``carry`` adds
    columns under names of their own. Other columns play no part. No rows: no rows.
    """
    carry = carry or {}
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"),
        leaf_digest(*(F.col(c) for c in value_cols)).alias("leaf"),
        *[c.alias(f"carry_{name}") for name, c in carry.items()],
        F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")),
                   F.lit("-")).alias("grp"),
        F.monotonically_increasing_id().alias("rid")), "leaves")
    placed = written(_placed(rows, ["doc_id", "leaf", "rid"], "leaves").drop("rid")
                     .withColumn("digest", F.col("leaf")), "placed")
    out = ["doc_id", "leaf", "subroot", "root", "proof"]
    proofs = _proofs(placed, slab)
    return proofs.select(*out, *[F.col(f"carry_{c}").alias(c) for c in carry])


def _proofs(placed: DataFrame, slab: int) -> DataFrame:
    """The placed leaves with subroot, root and proof."""
    levels = _roots(placed, slab, "group")
    subroots = levels[-1].select(F.col("grp").alias("name"), "digest",
                                 F.lit("all").alias("grp"))
    top = _roots(written(_placed(subroots, ["name"], "groups"), "group-roots"), slab, "root")
    proofs = top[-1].select("grp", "idx", F.expr(f"cast(array() AS {STEPS})").alias("proof"),
                            F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    for below in reversed(top[:-1]):
        proofs = written(_sweep_down(below, proofs, slab), "root-down")
    if len(top) == 1:  # one group: its root is the root
        proofs = top[0].join(proofs.drop("digest"), ["grp", "idx"])
    proofs = proofs.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("idx"),
                           "proof", F.col("digest").alias("subroot"), "root")
    if len(levels) == 1:  # every group is a lone leaf
        return placed.join(proofs.drop("idx"), "grp")
    for below in reversed(levels[1:-1]):
        proofs = written(_sweep_down(below, proofs, slab), "group-down")
    return _sweep_down(placed, proofs, slab)


def op13_merkle(spark, sf_dir):
    """Leaves, roots and proofs of ``documents``, folded again from tampered rows.

    A row whose doc_id is null is a leaf like any other, in front of its group, and is never
    tampered with; null values are ``-``, empty ones ``0:``.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = DOCUMENT_COLUMNS
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0,
                      F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    out = manifest(docs, "doc_id", "lang", own, carry={
        "changed": leaf_digest(*(tampered if c == "n_chars" else F.col(c) for c in own))})
    return out.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
        fold(F.col("changed"), F.col("proof")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, lang, list_reduce(list_prepend(4294967295, flatten(list_transform(
           string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda h, x: CASE WHEN x >= 0 THEN xor(h, x)
                WHEN h % 2 = 1 THEN xor(h >> 1, 3988292384) ELSE h >> 1 END) AS rest,
    concat(CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END,
           CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END,
           CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END) AS head,
    n_chars, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS tail
  FROM documents),
leaves AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS place,
    sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END, tail)) AS leaf,
    sha256(concat(head, CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(shown AS VARCHAR)) || ':' || shown END, tail)) AS changed
  FROM (SELECT *, CASE WHEN xor(rest, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS shown FROM d)),
trees AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY place) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, [sha256(concat(nodes[2 * i + 1], coalesce(nodes[2 * i + 2], '')))
                           for i in range((len(nodes) + 1) // 2)]
  FROM trees WHERE len(nodes) > 1),
subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
  FROM trees WHERE len(nodes) = 1),
heads AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, [sha256(concat(nodes[2 * i + 1], coalesce(nodes[2 * i + 2], '')))
                     for i in range((len(nodes) + 1) // 2)]
  FROM heads WHERE len(nodes) > 1),
steps AS (
  SELECT l.doc_id, t.level AS lvl,
    CASE WHEN (l.place >> t.level) % 2 = 1 THEN t.nodes[l.place >> t.level] ELSE '' END AS before,
    CASE WHEN (l.place >> t.level) % 2 = 0 THEN coalesce(t.nodes[(l.place >> t.level) + 2], '') ELSE '' END AS after
  FROM leaves l JOIN trees t ON l.lang IS NOT DISTINCT FROM t.lang AND len(t.nodes) > 1
  UNION ALL
  SELECT l.doc_id, 100 + h.level,
    CASE WHEN (s.place >> h.level) % 2 = 1 THEN h.nodes[s.place >> h.level] ELSE '' END,
    CASE WHEN (s.place >> h.level) % 2 = 0 THEN coalesce(h.nodes[(s.place >> h.level) + 2], '') ELSE '' END
  FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN heads h ON len(h.nodes) > 1),
proofs AS (
  SELECT doc_id, list(before ORDER BY lvl) AS lefts, list(after ORDER BY lvl) AS rights,
         sha256(string_agg(before || after, '' ORDER BY lvl)) AS proof_sha256
  FROM steps GROUP BY doc_id),
folds AS (
  SELECT l.doc_id, 1 AS lvl, l.changed AS own, p.lefts, p.rights
  FROM leaves l JOIN proofs p USING (doc_id)
  UNION ALL
  SELECT doc_id, lvl + 1, sha256(concat(lefts[lvl], own, rights[lvl])), lefts, rights
  FROM folds WHERE lvl <= len(lefts))
SELECT l.doc_id, l.leaf, s.subroot, (SELECT nodes[1] FROM heads WHERE len(nodes) = 1) AS root,
       p.proof_sha256, f.own AS folded_root,
       f.own = (SELECT nodes[1] FROM heads WHERE len(nodes) = 1) AS verified
FROM leaves l JOIN proofs p USING (doc_id) JOIN folds f ON f.doc_id = l.doc_id AND f.lvl > len(f.lefts)
JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
"""
