"""Suffix-array dedup: longest-previous-factor arrays over buckets of suffixes.

A byte belongs to a repeat when a string of ``length`` bytes that covers it also starts
somewhere else. A longest-previous-factor (LPF) array says, for every position, how long the
longest match is that starts earlier; previous and next smaller positions in suffix order
give the two candidates for it. A position starts a later copy when its LPF reaches
``length``; with the mirrored array (next factors) first copies are found as well.

One suffix array over a corpus is not a Spark job, so suffixes are first dealt into buckets
that matching windows cannot leave:

1. Every window of ``length`` bytes is assigned to its smallest ``GRAM``-byte gram by hash
   (its anchor). Equal windows have equal anchors at equal offsets. Consecutive windows with
   the same anchor are one row: (anchor hash, hash of the bytes they cover, place).
2. Anchors whose hash occurs once have no match and are dropped.
3. Rows whose covered bytes are equal are copies of each other as a whole; one of them goes
   on for all, with its first place.
4. ``PIECE`` windows at neighbouring offsets from an anchor are a piece: the ``core`` that all
   of them cover, and a few bytes left and right of it. Equal windows lie in pieces with equal
   cores. Pieces are put in the order of (core, left, right, place); a piece next to one with
   the same core may hold matches, one next to an equal piece is a match as a whole, and of
   equal pieces the first goes on for all.
5. The windows of the remaining pieces are put in suffix order: by core, offset and the bytes
   beside the core, equal ones by place. In that order the nearest smaller position with a
   common prefix of full length is the row before, the nearest larger one the row after, so a
   window's previous (next) factor reaches ``length`` when that row has the same bytes.

Both orders are range partitionings, places included, so a passage that a third of all texts
share is dealt over many tasks like any other, and there is one way for buckets of every size.
What a row needs from its neighbours it reads in passing; only the two rows at a partition's
ends look across, through a table of as many rows as there are partitions. A core is held as two
independent 64-bit hashes of its bytes, the bytes beside it as they are.

Rows of hot buckets meet their result on (bucket, run), see ``attach``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import attach, text_of
from sparkrisk.workspace import written

LENGTH = 200
GRAM = 32
PIECE = 16
CHUNK_BYTES = 1 << 17
_PLACE_BITS = 24
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_POWERS: dict[tuple[int, int], np.ndarray] = {}

ANCHOR_TYPE = ("doc_id {kind}, version int, start int, back int, width int, "
               "anchor long, context long")


def _mixed(x: np.ndarray) -> np.ndarray:
    """``x`` with its bits spread, in place."""
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def _totals(data: np.ndarray, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Running polynomial sums, and what turns a difference of two into a hash by its start."""
    up, down = _powers(len(data) + 1, which)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    terms = data.astype(np.uint64)
    terms += np.uint64(1)
    if which:  # bytes go in mixed, so the two hashes have nothing in common
        terms = _mixed(terms)
    terms *= up[:len(data)]
    np.cumsum(terms, out=total[1:])
    return total, down


def _powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a hash base and of its inverse, modulo 2^64."""
    if len(_POWERS.get((which, 0), ())) < n:
        size = max(n, CHUNK_BYTES + 4 * LENGTH)
        for sign, base in enumerate((_BASES[which], pow(_BASES[which], -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[which, sign] = np.multiply.accumulate(row)
    return _POWERS[which, 0][:n], _POWERS[which, 1][:n]


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH,
            gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(start, anchor place, width, anchor hash, context hash) of runs of windows.

    ``data`` are the bytes of texts one after another, ``ends`` where each ends; no window
    crosses an end. A run has the windows that start at start, start + 1, ..., start + width.
    """
    n, span = len(data), length - gram + 1
    if n < length:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    total, down = _totals(data)
    keys = total[gram:] - total[:-gram]
    keys *= down[:len(keys)]
    _mixed(keys)
    # smallest gram of each window, the first of equals: its place is in the low bits
    low = np.uint64((1 << _PLACE_BITS) - 1)
    blocks = np.full((-(-len(keys) // span), span), np.iinfo(np.uint64).max, dtype=np.uint64)
    padded = blocks.reshape(-1)
    np.bitwise_and(keys, ~low, out=padded[:len(keys)])
    padded[:len(keys)] |= np.arange(len(keys), dtype=np.uint64)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    windows = n - length + 1
    place = np.minimum(behind[:windows], ahead[span - 1:span - 1 + windows])
    place &= low
    place = place.view(np.int64)
    # windows that cross an end belong to no run
    cross = (ends[:-1, None] + np.arange(1 - length, 0)).ravel()
    place[cross[(cross >= 0) & (cross < windows)]] = -1
    first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
    width = np.diff(np.concatenate([first, [windows]])) - 1
    real = place[first] >= 0
    at, width = first[real], width[real]
    place = place[at]
    covered = (total[at + width + length] - total[at]) * down[at]
    shape = ((place - at) * 4096 + width + 1).astype(np.uint64)
    return (at, place, width, keys[place].view(np.int64),
            _mixed(covered + _mixed(shape)).view(np.int64))


def _anchor_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def flush(some: list[tuple[int, int, bytes]], batch: pa.RecordBatch):
        data = np.frombuffer(b"".join(t for *_, t in some), dtype=np.uint8)
        ends = np.cumsum([len(t) for *_, t in some])
        at, place, width, anchor, context = anchors(data, ends, length)
        own = np.searchsorted(ends, at, side="right")
        begin = (ends - [len(t) for *_, t in some])[own]
        row = pa.array(np.array([r for r, *_ in some])[own])
        shift = np.array([s for _, s, _ in some])[own]
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(row), batch.column("version").take(row),
            pa.array((at - begin + shift).astype(np.int32)),
            pa.array((place - at).astype(np.int32)), pa.array(width.astype(np.int32)),
            pa.array(anchor), pa.array(context)],
            names=["doc_id", "version", "start", "back", "width", "anchor", "context"])

    for batch in batches:
        some, size = [], 0
        for row, text in enumerate(batch.column("text").cast(pa.binary())):
            raw = text.as_py()
            # a very long text goes in parts that overlap by a window
            for shift in range(0, max(1, len(raw) - length + 1), CHUNK_BYTES):
                part = raw[shift:shift + CHUNK_BYTES + length - 1]
                if len(part) < length:
                    continue
                if size + len(part) > CHUNK_BYTES + length and some:
                    yield flush(some, batch)
                    some, size = [], 0
                some.append((row, shift, part))
                size += len(part)
        if some:
            yield flush(some, batch)


_RANGE = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
RANGE_TYPE = "array<struct<first:int,last:int>>"


def _cut_pieces(data: np.ndarray, raw: bytes, start: np.ndarray, back: np.ndarray,
                width: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(context, low, core hash, second hash, left, right) of the pieces of contexts.

    ``start`` are the contexts' places in ``data``, ``low`` is the place of a piece's first
    window in its context; pieces at the ends may lie over them.
    """
    first = (-back) // PIECE
    count = (width - back) // PIECE - first + 1
    row = np.repeat(np.arange(len(start)), count)
    piece = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    low = piece * PIECE + back[row]
    at = start[row]
    a, b = at + low + PIECE - 1, at + low + length
    hashes = []
    for which in (0, 1):
        total, down = _totals(data, which)
        hashes.append(_mixed((total[b] - total[a]) * down[a]).view(np.int64))
    begin = (at + np.maximum(low, 0)).tolist()
    stop = (at + np.minimum(low + PIECE - 1, width[row]) + length).tolist()
    left = [raw[x:y] for x, y in zip(begin, a.tolist(), strict=True)]
    right = [raw[x:y] for x, y in zip(b.tolist(), stop, strict=True)]
    return row, low, *hashes, left, right


def _piece_rows(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of the contexts that are cut from each text."""
    def flush(parts: list[bytes], some: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = b"".join(parts)
        text, cid, start, back, width, shift = (np.concatenate(x) for x in zip(*some, strict=True))
        row, low, core, second, left, right = _cut_pieces(
            np.frombuffer(raw, dtype=np.uint8), raw, start, back, width, length)
        taken = pa.array(text[row])
        return pa.RecordBatch.from_arrays([
            batch.column("doc_id").take(taken), batch.column("version").take(taken),
            pa.array((start + shift)[row] + low), pa.array(cid[row]),
            pa.array(low.astype(np.int32)), pa.array(width[row].astype(np.int32)),
            pa.array(core), pa.array(second), pa.array(left, pa.binary()),
            pa.array(right, pa.binary())],
            names=["doc_id", "version", "at", "cid", "low", "width", "core", "second", "left",
                   "right"])

    for batch in batches:
        cuts = batch.column("cuts")
        offsets = cuts.offsets.to_numpy()
        cid, begin, back, width = (
            pa.compute.struct_field(cuts.values, name).to_numpy(zero_copy_only=False)
            .astype(np.int64) for name in ("cid", "start", "back", "width"))
        parts, some, size = [], [], 0
        for row, text in enumerate(batch.column("text").cast(pa.binary())):
            raw = text.as_py()
            own = np.arange(offsets[row], offsets[row + 1])
            own = own[np.argsort(begin[own], kind="stable")]
            at = 0
            while at < len(own):  # contexts that start within a chunk of the text
                low = int(begin[own[at]])
                to = int(np.searchsorted(begin[own], low + CHUNK_BYTES))
                held = own[at:to]
                part = raw[low:int((begin[held] + width[held]).max()) + length]
                parts.append(part)
                some.append((np.full(len(held), row), cid[held], begin[held] - low + size,
                             back[held], width[held], np.full(len(held), low - size)))
                size += len(part)
                at = to
                if size > CHUNK_BYTES:
                    yield flush(parts, some, batch)
                    parts, some, size = [], [], 0
        if parts:
            yield flush(parts, some, batch)


def _same(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row but the last has the keys of the row after it."""
    same = np.ones(max(0, batch.num_rows - 1), dtype=bool)
    for key in keys:
        column = batch.column(key)
        same &= pa.compute.equal(column.slice(0, len(same)), column.slice(1)).to_numpy(
            zero_copy_only=False)
    return same


def neighbours(rows: DataFrame, keys: dict[str, list[str]], order: list[str],
               name: str) -> DataFrame:
    """``rows`` in the order of ``order``, with what they have in common with those beside them.

    For each entry of ``keys`` the columns ``<entry>_before`` and ``<entry>_after`` say whether
    the row before and the row after have equal values in its columns, none of which is null.
    The order is a range partitioning; rows that are equal in the first columns of ``order`` are
    dealt by the others. ``rows`` are read twice: once for the ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = list(rows.columns)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.RecordBatch | None = None
        known = {key: False for key in keys}
        opening = True

        def told(batch: pa.RecordBatch, n: int, closing: bool) -> pa.RecordBatch:
            """The first ``n`` rows; the row after the last of them is there or there is none."""
            nonlocal known, opening
            arrays = [batch.column(c).slice(0, n) for c in names]
            for key, columns in keys.items():
                same = _same(batch, columns)
                before = np.concatenate([[known[key]], same])[:n]
                after = np.concatenate([same, [False]])[:n]
                known = known | {key: bool(same[n - 1]) if n <= len(same) else False}
                arrays += [pa.array(before), pa.array(after)]
            first = np.zeros(n, dtype=bool)
            first[:1] = opening
            last = np.zeros(n, dtype=bool)
            last[n - 1:] = closing
            opening = False
            flags = [f"{key}_{side}" for key in keys for side in ("before", "after")]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(first), pa.array(last)],
                                              names=[*names, *flags, "opens", "closes"])

        for batch in batches:
            if not batch.num_rows:
                continue
            if tail is not None:
                batch = pa.concat_batches([tail, batch])
            if batch.num_rows > 1:
                yield told(batch, batch.num_rows - 1, False)
            tail = batch.slice(batch.num_rows - 1)
        if tail is not None:
            yield told(tail, 1, True)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in names),
                        *(f"{key}_{side} boolean" for key in keys for side in ("before", "after")),
                        "opens boolean", "closes boolean"])
    told = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(
        compare, schema).withColumn("part", F.spark_partition_id()), name)
    # two rows of every partition: its first and its last
    ends = sorted(told.where("opens OR closes").collect(), key=lambda r: (r["part"], r["closes"]))
    firsts = [r for r in ends if r["opens"]]
    lasts = [r for r in ends if r["closes"]]
    across = []
    for k, row in enumerate(firsts):
        flags = []
        for columns in keys.values():
            flags += [k > 0 and all(row[c] == lasts[k - 1][c] for c in columns),
                      k + 1 < len(firsts) and all(lasts[k][c] == firsts[k + 1][c] for c in columns)]
        across.append((row["part"], *flags))
    edges = rows.sparkSession.createDataFrame(across, ", ".join(
        ["part int", *(f"{key}_{side}_there boolean" for key in keys for side in ("before", "after"))]))
    met = told.join(F.broadcast(edges), "part")
    return met.select(*names, *[
        (F.col(f"{key}_{side}") | (F.col(end) & F.col(f"{key}_{side}_there"))).alias(f"{key}_{side}")
        for key in keys for side, end in (("before", "opens"), ("after", "closes"))])


def _pieces(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """Pieces of the ``wanted`` contexts (cid and place), cut from the texts."""
    per_text = wanted.groupBy("doc_id", "version").agg(F.collect_list(F.struct(
        "cid", "start", "back", "width")).alias("cuts"))
    met = docs.join(per_text.withColumnsRenamed({"doc_id": "_id", "version": "_version"}),
                    F.col("doc_id").eqNullSafe(F.col("_id"))
                    & (F.col("version") == F.col("_version")))
    kind = dict(docs.dtypes)["doc_id"]
    return met.select("doc_id", "version", "text", "cuts").mapInArrow(
        lambda b: _piece_rows(b, length),
        f"doc_id {kind}, version int, at long, cid long, low int, width int, core long,"
        " second long, left binary, right binary")


def _factors(pieces: DataFrame, length: int, first_stays: bool) -> DataFrame:
    """(cid, found): ranges of the windows of each context that have a full factor."""
    late = F.col("doc_id").isNull().alias("late")
    place = ["late", "doc_id", "version", "at", "cid"]
    core, beside = ["core", "second"], ["left", "right"]
    near = neighbours(pieces.select("*", late), {"core": core, "whole": core + beside},
                      [*core, *beside, *place], "pieces-in-order")
    near = near.where("core_before OR core_after")
    hit = F.col("whole_before") if first_stays else F.col("whole_before") | F.col("whole_after")
    whole = near.where(hit).select(
        "cid", F.greatest("low", F.lit(0)).alias("first"),
        F.least(F.col("low") + PIECE - 1, "width").alias("last"))
    # of equal pieces the first stands for all
    windows = near.where(~F.col("whole_before")).select(
        *core, *place, "low", F.expr(
            f"""explode(transform(
                sequence(greatest(0, -low), least({PIECE - 1}, width - low)), k -> struct(
                    k, concat(substring(left, low + k - greatest(low, 0) + 1, {PIECE - 1}),
                              substring(right, 1, k)) AS beside)))""").alias("w")).select(
        *core, *place, (F.col("low") + F.col("w.k")).alias("first"), "w.k", "w.beside")
    found = neighbours(windows, {"window": [*core, "k", "beside"]},
                       [*core, "k", "beside", *place], "windows-in-order")
    hit = F.col("window_before") if first_stays else F.col("window_before") | F.col("window_after")
    single = found.where(hit).select("cid", "first", F.col("first").alias("last"))
    return whole.unionByName(single).groupBy("cid").agg(
        F.array_sort(F.collect_list(F.struct("first", "last"))).alias("found"))


def repeats(docs: DataFrame, length: int = LENGTH, first_stays: bool = True) -> DataFrame:
    """Byte ranges (doc_id, version, low, high) of repeats; ranges may overlap.

    ``docs`` has doc_id, version (a hash of the text, to tell rows with the same id apart)
    and text without nulls.
    """
    kind = dict(docs.dtypes)["doc_id"]
    found = docs.mapInArrow(lambda b: _anchor_rows(b, length), ANCHOR_TYPE.format(kind=kind))
    # written, so that both sides of the join are plain exchanges, whose hot keys Spark splits
    often = written(found.groupBy("anchor").agg(F.count("*").alias("seen")).where("seen > 1")
                    .select("anchor"), "anchors-seen")
    rows = written(found.join(often.hint("merge"), "anchor").withColumn(
        "run", F.spark_partition_id()), "anchors")
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "version", "start",
                     "back", "width")
    classes = written(rows.groupBy("anchor", "context").agg(
        F.count("*").alias("n"), F.min(place).alias("rep")), "contexts")
    groups = written(classes.groupBy("anchor").agg(F.count("*").alias("alike"))
                     .where("alike > 1").select("anchor"), "buckets")
    wanted = written(classes.join(groups.hint("merge"), "anchor").select(
        "anchor", "context", "rep.doc_id", "rep.version", "rep.start", "rep.back",
        "rep.width").withColumn("cid", F.monotonically_increasing_id()), "wanted")
    pieces = written(_pieces(docs, wanted, length), "pieces")
    compared = written(_factors(pieces, length, first_stays).join(
        wanted.select("cid", "anchor", "context"), "cid").drop("cid"), "factors")
    verdict = classes.join(compared, ["anchor", "context"], "left").where(
        (F.col("n") > 1) | F.col("found").isNotNull())
    met = attach(rows, verdict.select("anchor", "context", "n", "rep", "found"),
                 ["anchor", "context"]).where(F.col("n").isNotNull())
    all_of_it = F.array(F.struct(F.lit(0).alias("first"), F.col("width").alias("last")))
    if first_stays:
        own = place == F.col("rep")
        ranges = F.when(own, F.coalesce("found", F.array().cast(RANGE_TYPE))).otherwise(all_of_it)
    else:
        ranges = F.when(F.col("n") > 1, all_of_it).otherwise(F.col("found"))
    return met.select("doc_id", "version", "start", F.explode(ranges).alias("r")).select(
        "doc_id", "version", (F.col("start") + F.col("r.first")).alias("low"),
        (F.col("start") + F.col("r.last") + length).alias("high"))


RESULT = ("doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{more}")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 length: int = LENGTH, first_stays: bool = True,
                 with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty; matches never cross rows. With ``first_stays`` the
    first copy of a repeat (by id, null ids last, then place) is kept and later ones are
    removed; without it all copies are. Repeats are judged on the input, overlaps count.
    n_spans are the maximal removed runs. ``with_text`` adds the remaining bytes as ``kept``
    (binary) and the runs as ``spans``. Rows that repeat an id and its text get the same
    result; where the first stays they count as one. An empty table gives no rows.
    """
    if length % 8 or length < 64:
        raise ValueError("length must be a multiple of 8 and at least 64")
    own = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")).withColumn(
        "version", F.hash("text"))
    kind = dict(own.dtypes)["doc_id"]
    spans = repeats(own, length, first_stays).groupBy("doc_id", "version").agg(
        F.collect_list(F.struct("low", "high")).alias("ranges")).withColumnsRenamed(
        {"doc_id": "_id", "version": "_version"})
    met = own.join(spans, F.col("doc_id").eqNullSafe(F.col("_id"))
                   & (F.col("version") == F.col("_version")), "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n", "gone", "runs", "sha", "kept", "spans")}
            for text, ranges in zip(batch.column("text").cast(pa.binary()),
                                    batch.column("ranges"), strict=True):
                raw = text.as_py()
                runs: list[list[int]] = []
                for r in sorted((r["low"], r["high"]) for r in ranges.as_py() or ()):
                    if runs and r[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], r[1])
                    else:
                        runs.append(list(r))
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for name, value in (("n", len(raw)), ("gone", len(raw) - len(kept)),
                                    ("runs", len(runs)),
                                    ("sha", hashlib.sha256(kept).hexdigest())):
                    out[name].append(value)
                if with_text:
                    out["kept"].append(kept)
                    out["spans"].append([{"first": a, "last": b - 1} for a, b in runs])
            arrays = [batch.column("doc_id"), pa.array(out["n"], pa.int64()),
                      pa.array(out["gone"], pa.int64()), pa.array(out["runs"], pa.int64()),
                      pa.array(out["sha"], pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                arrays += [pa.array(out["kept"], pa.binary()), pa.array(out["spans"], _RANGE)]
                names += ["kept", "spans"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    more = f", kept binary, spans {RANGE_TYPE}" if with_text else ""
    return met.select("doc_id", "text", "ranges").mapInArrow(
        remove, RESULT.format(kind=kind, more=more))


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), first_stays=False)
