"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures.

A signature has ``POSITIONS`` minima of a text's shingle set under different hash functions,
``BITS`` bits of each. Two sets of similarity s differ in a position with probability 1 - s, so
sets at the threshold of 0.8 differ in more than ``MAX_ERRORS`` = 23 of 48 positions with
probability 1e-5. All pairs at signature distance 23 or less are found:

Cut into m segments, two such signatures have a segment with at most floor(23 / m) differing
positions. Every segment is indexed under each way to leave out that many positions, and texts
that share a key are joined on it. ``SEGMENTS`` gives m: 12 segments of 4 with one error are 48
keys of three positions a text.

Only components are wanted, so no key enumerates its pairs. Per key:

1. Its pivot, the member that shares most keys with others, is compared with all members, and
   what is linked is united.
2. A key whose members are in one component by then has nothing to add. In any other key only
   the members outside its largest component, the strays, can have further links.
3. What is known of a stray bounds the size of its difference to any other member. Let l be how
   much of the pivot's set a member lacks, and u how many of its shingles only its component
   has, of all texts in open keys: members of two components differ in at least
   u + u' + |l - l'| shingles. A stray that differs
   too much from every other member is done, and so is a member that differs too much from
   every stray; most near copies that were changed too much to be linked end here.
4. The remaining strays and members are compared where the bound allows it. Where there are
   more than ``outside`` of both, a second bound is taken first: a sketch of ``SKETCH`` bits has
   the parity of how many shingles fall on each bit, and two sets differ in at least as many
   shingles as their sketches differ in bits. Two texts that share several keys meet in the
   first one only: what leaves them out in any key proves that they are not linked, or already
   united.

With more than one entry in ``SEGMENTS`` the members of keys that are crowded on both sides are
indexed again with fewer and longer segments, and compared in the last index.

A pair is compared by set sizes, then by signature distance, then by the full shingle sets of
both texts. Texts with the same word sequence are one from the start.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import attach, components, numbered, text_of
from sparkrisk.workspace import written

SHINGLE = 4
SIMILARITY = 80
POSITIONS = 48
MAX_ERRORS = 23
SEGMENTS = (12,)
OUTSIDE = 16
SKETCH = 1024
BATCH_WORDS = 1 << 16
KEY_ROWS = 1 << 17
_MASK = np.uint64(0xFFFF)
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_ODD = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _ODD[0]
    return x ^ (x >> np.uint64(29))


def signatures(texts: list[list[bytes]], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Set sizes and signatures (one row of 16-bit symbols each) of lists of words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    counts = np.where(sizes >= shingle, sizes - shingle + 1, np.minimum(sizes, 1))
    out = np.zeros((len(texts), POSITIONS), dtype=np.uint16)
    if not sizes.sum():
        return counts, out
    codes, uniques = pd.factorize(np.array([w for t in texts for w in t], dtype=object))
    codes = codes.astype(np.uint64)
    own = np.array([xxhash.xxh64_intdigest(w) for w in uniques], dtype=np.uint64)[codes]
    begin = np.cumsum(sizes) - sizes
    # where each shingle starts; a text of fewer words has one shingle of all its words
    row = np.repeat(np.arange(len(texts)), counts)
    at = begin[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    width = np.minimum(sizes, shingle)[row]
    grams = np.zeros(len(at), dtype=np.uint64)
    packed = np.zeros(len(at), dtype=np.uint64)
    for k in range(shingle):
        there = width > k
        place = np.where(there, at + k, 0)
        grams += np.where(there, own[place] * _ODD[k + 1], np.uint64(0))
        grams = _mixed(grams)
        packed = packed * np.uint64(len(uniques)) + np.where(there, codes[place], np.uint64(0))
    if len(uniques) ** shingle < 1 << 64:  # the words of a shingle are one number
        by = np.lexsort([packed, row])
        new = np.ones(len(by), dtype=bool)
        new[1:] = (packed[by][1:] != packed[by][:-1]) | (row[by][1:] != row[by][:-1])
        distinct = np.bincount(row[by][new], minlength=len(texts))
    else:
        distinct = np.array([
            len(set(zip(*(t[k:] for k in range(shingle)), strict=False))) if len(t) >= shingle
            else min(len(t), 1) for t in texts], dtype=np.int64)
    held = np.flatnonzero(counts)
    edges = (np.cumsum(counts) - counts)[held]
    for k in range(POSITIONS):
        least = np.minimum.reduceat(grams * _FACTORS[k] + _SHIFTS[k], edges)
        out[held, k] = (_mixed(least) & _MASK).astype(np.uint16)
    return distinct, out


def _print_rows(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        some: list[list[bytes]] = []
        rows: list[int] = []
        size = 0

        def flushed(batch=batch, some=some, rows=rows) -> pa.RecordBatch:
            distinct, symbols = signatures(some, shingle)
            bodies = [b" ".join(t) for t in some]
            flat = pa.array(symbols.ravel().view(np.int16), pa.int16())
            return pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                pa.array(distinct.astype(np.int64)),
                pa.array([hashlib.sha256(b).digest() for b in bodies], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(
                    0, symbols.size + 1, POSITIONS, dtype=np.int32)), flat),
                pa.array(bodies, pa.binary())],
                names=["doc_id", "n_shingles", "sha", "sig", "body"])

        for row, text in enumerate(batch.column("text").cast(pa.binary())):
            words = text.as_py().lower().split()
            some.append(words)
            rows.append(row)
            size += len(words) + 1
            if size >= BATCH_WORDS:
                yield flushed()
                some.clear()
                rows.clear()
                size = 0
        if some:
            yield flushed()


def _choices(segments: int, max_errors: int) -> tuple[list[tuple[int, ...]], int]:
    """The positions a segment is indexed without, choice by choice, and the bits of a place.

    A place is the number of a segment and choice; the lowest bits of a key are its place.
    """
    found = list(combinations(range(POSITIONS // segments), max_errors // segments))
    return found, (segments * len(found) - 1).bit_length()


def keys_of(symbols: np.ndarray, segments: int, max_errors: int = MAX_ERRORS) -> np.ndarray:
    """Keys of each signature, one column per segment and choice of positions left out."""
    width, out = POSITIONS // segments, []
    choices, bits = _choices(segments, max_errors)
    salted = _mixed(symbols.astype(np.uint64) + np.arange(
        1, POSITIONS + 1, dtype=np.uint64) * np.uint64(1 << 16)) * _ODD[7]
    for n in range(segments):
        cut = salted[:, n * width:(n + 1) * width]
        whole = cut.sum(axis=1, dtype=np.uint64)
        for left_out in choices:
            kept = whole - cut[:, list(left_out)].sum(axis=1, dtype=np.uint64)
            kept += np.uint64(len(out) + 1) << np.uint64(48)
            out.append(_mixed(kept) << np.uint64(bits) | np.uint64(len(out)))
    return np.stack(out, axis=1)


def first_shared(a: Column, b: Column, segments: int, max_errors: int = MAX_ERRORS) -> Column:
    """The lowest place at which two signatures have the same key, null if there is none."""
    width, (choices, _) = POSITIONS // segments, _choices(segments, max_errors)
    # by which positions of a segment differ, the first one being the highest bit
    covering = F.array(*[F.lit(next(
        (n for n, left_out in enumerate(choices)
         if all(k in left_out for k in range(width) if differ >> (width - 1 - k) & 1)), None)
        ).cast("int") for differ in range(1 << width)])

    def place(differ: Column) -> Column:
        return F.coalesce(*[F.get(covering, F.shiftright(
            differ, POSITIONS - (n + 1) * width).bitwiseAND((1 << width) - 1).cast("int"))
            + n * len(choices) for n in range(segments)])

    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 0).otherwise(1)),
                       F.lit(0).cast("long"), lambda n, x: n * 2 + x, place)


def _index(prints: DataFrame, segments: int, max_errors: int) -> DataFrame:
    """Rows (key, node, root) of ``prints`` (node, root, sig)."""
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column("sig").flatten().to_numpy(zero_copy_only=False)
            symbols = symbols.view(np.uint16).reshape(-1, POSITIONS)
            node, root = (batch.column(c).to_numpy() for c in ("node", "root"))
            first = keys_of(symbols[:1], segments, max_errors).shape[1] if len(node) else 1
            step = max(1, KEY_ROWS // first)
            for at in range(0, len(node), step):
                keys = keys_of(symbols[at:at + step], segments, max_errors)
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.ravel().view(np.int64)),
                    pa.array(np.repeat(node[at:at + step], keys.shape[1])),
                    pa.array(np.repeat(root[at:at + step], keys.shape[1]))],
                    names=["key", "node", "root"])

    return prints.select("node", "root", "sig").mapInArrow(index, "key long, node long, root long")


def _beside(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """``pairs`` (a, b, run) with the facts (node, ...) of both, as a_... and b_...

    A text is the b of few pairs, but may be the a of very many.
    """
    names = [c for c in facts.columns if c != "node"]
    for side in ("b", "a"):
        own = facts.select(F.col("node").alias(side),
                           *[F.col(c).alias(f"{side}_{c}") for c in names])
        pairs = pairs.join(own, side) if side == "b" else attach(pairs, own, [side])
    return pairs


def _shingles(body: bytes, shingle: int) -> set:
    words = body.split()
    if len(words) < shingle:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(shingle)), strict=False))


def _compared(pairs: DataFrame, prints: DataFrame, shingle: int, similarity: int,
              max_errors: int | None = None) -> DataFrame:
    """The ``pairs`` (a, b) with how many shingles they share, and whether that links them.

    With ``max_errors`` pairs whose sizes or signatures differ too much are left out.
    """
    pairs = pairs.distinct().withColumn("run", F.spark_partition_id())
    if max_errors is not None:
        near = _beside(written(pairs, "candidates"), prints.select(
            "node", F.col("n_shingles").alias("n"), "sig"))
        differ = F.zip_with("a_sig", "b_sig", lambda x, y: F.when(x == y, 0).otherwise(1))
        pairs = near.where(
            (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * similarity)
            & (F.aggregate(differ, F.lit(0), lambda n, x: n + x) <= max_errors)).select(
            "a", "b", "run")
    bodies = prints.select("node", "body")
    # pivots meet a good part of all texts, which is a merge join at every size; later pairs are few
    met = _beside(written(pairs, "pairs"),
                  bodies.hint("merge") if max_errors is None else bodies)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, set()
        for batch in batches:
            both, flags = [], []
            for a, a_body, b_body in zip(*(batch.column(c) for c in ("a", "a_body", "b_body")),
                                         strict=True):
                if a.as_py() != last:  # pairs of one pivot come together
                    last, held = a.as_py(), _shingles(a_body.as_py(), shingle)
                other = _shingles(b_body.as_py(), shingle)
                both.append(len(held & other))
                flags.append(100 * both[-1] >= similarity * (len(held) + len(other) - both[-1]))
            yield pa.RecordBatch.from_arrays([
                batch.column("a"), batch.column("b"), pa.array(both, pa.int64()),
                pa.array(flags, pa.bool_())], names=["a", "b", "both", "linked"])

    return written(met.select("a", "b", "a_body", "b_body").mapInArrow(
        verify, "a long, b long, both long, linked boolean"), "compared")


def _hashes(body: bytes, shingle: int) -> np.ndarray:
    return np.unique(np.array([xxhash.xxh64_intdigest(b" ".join(s))
                               for s in _shingles(body, shingle)], dtype=np.uint64))


def parities(hashes: np.ndarray) -> np.ndarray:
    """``SKETCH`` bits as signed words: whether an odd number of hashes falls on each bit."""
    odd = np.bincount((hashes % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketched(nodes: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """(node, sig, sketch) of the ``nodes`` (node)."""
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [parities(_hashes(b.as_py(), shingle)) for b in batch.column("body")]
            yield pa.RecordBatch.from_arrays([
                batch.column("node"), batch.column("sig"),
                pa.array([w.tolist() for w in words], pa.list_(pa.int64()))],
                names=["node", "sig", "sketch"])

    # a table of its own: Spark sees that it is short and leaves the bodies where they are
    nodes = written(nodes, "sketched")
    return written(prints.select("node", "sig", "body").join(nodes, "node").mapInArrow(
        sketch, "node long, sig array<short>, sketch array<long>"), "sketches")


def _private(nodes: DataFrame, prints: DataFrame, shingle: int) -> DataFrame:
    """(node, private): how many shingles of a node only its component has, or fewer.

    ``nodes`` are (node, root). Shingles are held as hashes; two that agree by chance only make
    the count smaller.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, root, body in zip(*(batch.column(c) for c in ("node", "root", "body")),
                                        strict=True):
                own = _hashes(body.as_py(), shingle).view(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(own), pa.array(np.full(len(own), node.as_py())),
                    pa.array(np.full(len(own), root.as_py()))], names=["h", "node", "root"])

    rows = written(prints.select("node", "body").join(nodes, "node").mapInArrow(
        hashed, "h long, node long, root long"), "crowd-shingles")
    own = rows.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low = high").select("h")
    return rows.join(own, "h").groupBy("node").agg(F.count("*").alias("private"))


def links(prints: DataFrame, shingle: int = SHINGLE, similarity: int = SIMILARITY,
          max_errors: int = MAX_ERRORS, segments: tuple[int, ...] = SEGMENTS,
          outside: int = OUTSIDE) -> DataFrame:
    """Links (a, b) whose components are those of all similar pairs within ``max_errors``.

    ``prints`` has one row (node, n_shingles, sig, body) per text.
    """
    found: list[DataFrame] = []

    def all_links() -> DataFrame:
        edges = found[0]
        for more in found[1:]:
            edges = edges.unionByName(more)
        return edges.where("linked").select("a", "b")

    def with_roots(rows: DataFrame) -> DataFrame:
        """``rows`` with ``root``, the component their node is in so far."""
        return rows.drop("root").join(components(all_links()), "node", "left").withColumn(
            "root", F.coalesce("root", "node"))

    def keys_with_roots(rows: DataFrame) -> DataFrame:
        """``rows`` (key, node, ...) with ``root``; a node meets it once, with all its keys."""
        held = [c for c in rows.columns if c not in ("node", "root")]
        return with_roots(rows.groupBy("node").agg(
            F.collect_list(F.struct(*held)).alias("held"))).select(
            "node", "root", F.inline("held"))

    def open_keys(rows: DataFrame) -> DataFrame:
        per_root = rows.groupBy("key", "root").agg(F.count("*").alias("n"))
        return per_root.groupBy("key").agg(
            F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("main")).where(
            "roots > 1").select("key", F.col("main.root").alias("main"))

    crowd = prints.withColumn("root", F.col("node"))
    for level, count in enumerate(segments):
        index = _index(crowd, count, max_errors)
        sizes = written(index.groupBy("key").agg(
            F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high"))
            .where("low < high").select("key", "size"), "keys")
        # a merge join at every size, whose hot keys Spark splits
        shared = written(index.join(sizes.hint("merge"), "key").withColumn(
            "run", F.spark_partition_id()), "shared-keys")
        weights = shared.groupBy("node").agg(F.sum("size").alias("weight"))
        pivots = shared.join(weights, "node").groupBy("key").agg(
            F.max(F.struct("weight", (-F.col("node")).alias("minus"))).alias("top")).select(
            "key", (-F.col("top.minus")).alias("a"))
        starred = written(attach(shared, written(pivots, "pivots"), ["key"]), "starred-keys")
        stars = _compared(starred.where("a <> node").select("a", F.col("node").alias("b")),
                          prints, shingle, similarity)
        found.append(stars)
        rooted = written(keys_with_roots(starred.where("size > 2")), "rooted-keys")
        left = written(open_keys(rooted), "open-keys")
        if left.isEmpty():
            break
        members = attach(rooted, left, ["key"], how="inner")
        # how far each member is from its key's pivot, and from all others at least
        members = members.join(prints.select("node", F.col("n_shingles").alias("n")), "node").join(
            _private(members.select("node", "root").distinct(), prints, shingle), "node", "left")
        members = attach(members.join(
            stars.select("a", F.col("b").alias("node"), "both"), ["a", "node"], "left"),
            prints.select(F.col("node").alias("a"), F.col("n_shingles").alias("a_n")), ["a"])
        members = written(members.select(
            "key", "node", "root", "main", "a", "run", "n",
            F.coalesce("private", F.lit(0)).alias("u"),
            (F.col("a_n") - F.when(F.col("node") == F.col("a"), F.col("a_n")).otherwise(
                F.col("both"))).alias("l")), "members")
        # a linked pair differs in at most (1 - s) / (1 + s) of both sizes: a member must lack
        # at least ``need`` more of the pivot than it has shingles of its own
        bound = members.groupBy("key").agg(F.max(F.col("l") - F.col("u")).alias("reach"),
                                           F.max("n").alias("widest"))
        sizes = F.col("n") + F.least(F.col("widest"), F.col("n") * 100 / similarity)
        need = F.col("u") + F.col("l") - sizes * (100 - similarity) / (100 + similarity)
        strays = attach(members, bound, ["key"]).where(
            (F.col("root") != F.col("main")) & (F.col("node") != F.col("a"))).withColumn(
            "need", need).where("coalesce(need <= reach, true)")
        strays = written(strays.select("key", "need", "run", F.struct(
            F.col("node").alias("x"), "root", "n", "u", "l").alias("stray")), "strays")
        counts = strays.groupBy("key").agg(F.count("*").alias("strays"), F.min(F.coalesce(
            "need", F.lit(float("-inf")))).alias("least"))
        # the members that may be linked to a stray
        own = written(attach(members.where("node <> a"), counts, ["key"], how="inner").where(
            "coalesce(l - u >= least, true)"), "partners")
        counts = written(counts.join(own.groupBy("key").agg(F.count("*").alias("partners")),
                                     "key"), "counts")
        last = level + 1 == len(segments)

        def listed(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
            """At most ``outside`` rows a key, as one row."""
            return rows.join(keys.select("key"), "key").groupBy("key").agg(
                F.collect_list(column).alias("others"))

        few = counts.where(F.col("strays") <= outside)
        other = counts.where(F.col("strays") > outside)
        own = own.withColumn("member", F.struct(F.col("node").alias("x"), "root", "n", "u", "l"))
        met = attach(own, listed(strays, "stray", few), ["key"]).select(
            "member", F.explode("others").alias("stray"))
        met = met.unionByName(attach(strays, listed(own, "member", other.where(
            F.col("partners") <= outside)), ["key"]).select(
            F.explode("others").alias("member"), "stray"))
        many = other.where(F.col("partners") > outside)
        m, s = F.col("member"), F.col("stray")
        apart = m["u"] + s["u"] + F.abs(m["l"] - s["l"])
        possible = (m["root"] != s["root"]) & F.coalesce(
            apart * (100 + similarity) <= (m["n"] + s["n"]) * (100 - similarity), F.lit(True))
        pairs = met.where(possible)
        crowded = not many.isEmpty()
        if last and crowded:
            places = (1 << _choices(count, max_errors)[1]) - 1
            m_here = own.join(many.select("key"), "key").select("key", "node", "member")
            s_here = strays.join(many.select("key"), "key").select(
                "key", F.col("stray.x").alias("node"), "stray")
            facts = _sketched(m_here.select("node").unionByName(s_here.select("node")).distinct(),
                              prints, shingle)
            m_here, s_here = (rows.join(facts, "node").select(
                "key", side, F.col("sig").alias(f"{side}_sig"),
                F.col("sketch").alias(f"{side}_sketch"))
                for rows, side in ((m_here, "member"), (s_here, "stray")))
            bits = sum(F.bit_count(F.col("member_sketch")[k].bitwiseXOR(F.col("stray_sketch")[k]))
                       for k in range(SKETCH // 64))
            first = first_shared(F.col("member_sig"), F.col("stray_sig"), count, max_errors)
            pairs = pairs.unionByName(m_here.join(s_here, "key").where(
                possible & (bits * (100 + similarity) <= (m["n"] + s["n"]) * (100 - similarity))
                & (first == F.col("key").bitwiseAND(places))).select("member", "stray"))
        found.append(_compared(pairs.select(
            F.least(m["x"], s["x"]).alias("a"), F.greatest(m["x"], s["x"]).alias("b")),
            prints, shingle, similarity, max_errors))
        if last or not crowded:
            break
        both = strays.select("key", F.col("stray.x").alias("node"), "run").unionByName(
            own.select("key", "node", "run"))
        crowd = attach(both, many.select("key"), ["key"], how="inner").select("node").distinct()
        crowd = written(with_roots(crowd).join(prints.select("node", "sig"), "node"), "crowd")
    return all_links()


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               shingle: int = SHINGLE, similarity: int = SIMILARITY,
               max_errors: int = MAX_ERRORS, segments: tuple[int, ...] = SEGMENTS,
               outside: int = OUTSIDE) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    A text's set are its distinct shingles of ``shingle`` words, A-Z in lower case; a text of
    fewer words has one of all its words. Texts are linked when 100 * intersection is at least
    ``similarity`` * union. component_id is the smallest id reachable, the row's own included.
    Null and empty texts and texts without a word have an empty set and are linked with
    nothing: each is its own component. Null ids are never the smallest unless a component has
    no other; ``kept`` is doc_id = component_id, also for two nulls, and holds for all rows
    that repeat an id. An empty table gives no rows.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    rows = numbered(docs.select(
        F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(
        lambda b: _print_rows(b, shingle),
        f"doc_id {kind}, n_shingles long, sha binary, sig array<short>, body binary"), "prints")
    full = rows.where("n_shingles > 0")
    nodes = written(full.groupBy("sha").agg(F.min("rid").alias("node"),
                                            F.min("doc_id").alias("least")), "nodes")
    prints = written(full.join(nodes.select("node"), F.col("rid") == F.col("node")).select(
        "node", "n_shingles", "sig", "body"), "node-prints")
    roots = components(links(prints, shingle, similarity, max_errors, segments, outside))
    member = written(nodes.join(roots, "node", "left").withColumn(
        "root", F.coalesce("root", "node")).withColumn("run", F.spark_partition_id()), "members")
    named = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = attach(member, named, ["root"]).select("sha", "component_id")
    out = attach(rows.select("doc_id", "n_shingles", "sha", "run"), found, ["sha"])
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op11_minhash(spark, sf_dir):
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
