"""Periodic runs of words: branching tandem repeats in an enhanced suffix array.

A run is a stretch of words with a smallest period q that no neighbouring word extends. Its
last square starts at i = end - 2q, and the suffixes at i and i + q part after exactly q words:
they lie in one LCP interval of depth q, in different children of it. So it is enough to look,
for every LCP interval of depth d, at the suffixes i of all its children but the largest, and to
ask through the inverse suffix array whether i + d or i - d lies in the interval, outside the
child of i. Each hit is the last square of a repeat of period d; rotating it to the left, word
by word while words d apart are equal, gives the run. Intervals are places in the array, found
by one pass over the LCP values; there are no tree nodes. Squares of a multiple of the period
end up at the same place as the run and are merged into it.

Many documents are one array: words are numbered per document and every document ends in a word
of its own, so no common prefix crosses documents. The array is built by prefix doubling that
touches only places not yet in order; the ranks of every doubling also answer how far two
places agree, which gives LCP values and rotations without a loop over words.

A run of period q and length L has two suffixes that share L - q words, so documents in which
no two suffixes share as many as the shortest run needs are not looked at any further.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import text_of

LEAST_LENGTH = 6
LEAST_PERIODS = 4
BATCH_WORDS = 1 << 17
RUNS = "array<struct<start:long,length:long,period:long>>"


def suffix_array(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix order, and the ranks by the first 1, 2, 4, ... words at every place.

    The last key of every text occurs once. A rank is the place in the order of the first
    suffix with the same words.
    """
    n = len(key)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, dtype=bool)
    head[1:] = key[order][1:] != key[order][:-1]
    every = np.arange(n)
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, every, 0))
    ranks, size = [rank], 1
    alone = head & np.append(head[1:], True)
    open_ = np.flatnonzero(~alone)
    while len(open_):
        at = order[open_]
        first, second = rank[at], rank[at + size]
        by = np.lexsort([second, first])
        at, first, second = at[by], first[by], second[by]
        order[open_] = at
        new = np.ones(len(at), dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        rank = rank.copy()
        rank[at] = open_[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        ranks.append(rank)
        size *= 2
        open_ = open_[~(new & np.append(new[1:], True))]
    return order, ranks


def common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """LCP of every suffix in order with the one before it; 0 for the first."""
    lcp = np.zeros(len(order), dtype=np.int64)
    near = np.flatnonzero(ranks[0][order[1:]] == ranks[0][order[:-1]]) + 1
    a, b = order[near - 1], order[near]
    length = np.zeros(len(near), dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        same = ranks[level][a + length] == ranks[level][b + length]
        length += same << level
    lcp[near] = length
    return lcp


def intervals(lcp: list[int]) -> tuple[np.ndarray, ...]:
    """(depth, low, high) of every LCP interval, and (interval, first, last) of its children.

    One pass with a stack of open intervals: its depth, where it begins, its last boundary and
    its number. ``lcp[0]`` is 0; intervals of depth 0 are left out.
    """
    depth: list[int] = []
    low: list[int] = []
    high: list[int] = []
    child: list[tuple[int, int, int]] = []
    stack = [[0, 0, 0, -1]]
    n = len(lcp)
    for k in range(1, n + 1):
        value = lcp[k] if k < n else 0
        while stack[-1][0] > value:
            _, _, last, number = stack.pop()
            high[number] = k - 1
            child.append((number, last, k - 1))
        top = stack[-1]
        if top[0] < value:
            number = len(depth)
            depth.append(value)
            low.append(top[2])
            high.append(-1)
            child.append((number, top[2], k - 1))
            stack.append([value, top[2], k, number])
        else:
            if value:
                child.append((top[3], top[2], k - 1))
            top[2] = k
    return (np.array(depth, dtype=np.int64), np.array(low, dtype=np.int64),
            np.array(high, dtype=np.int64),
            np.array(child, dtype=np.int64).reshape(-1, 3))


def tandems(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the branching squares of a stretch of the suffix array.

    ``order`` and ``lcp`` are whole groups of suffixes, their places being numbered anew.
    """
    depth, low, high, child = intervals(lcp.tolist())
    if not len(depth):
        return order[:0], order[:0]
    number, first, last = child.T
    size = last - first + 1
    # all children of an interval but its largest
    by = np.lexsort([size, number])
    largest = np.append(number[by][1:] != number[by][:-1], True)
    some = by[~largest]
    number, first, last, size = number[some], first[some], last[some], size[some]
    row = np.repeat(np.arange(len(some)), size)
    place = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    i, d, of = order[place], depth[number[row]], number[row]
    base, top = order.min(), order.max()
    inverse = np.full(top - base + 1, -1, dtype=np.int64)
    inverse[order - base] = np.arange(len(order))
    found = []
    for sign in (1, -1):
        j = i + sign * d
        inside = (j >= base) & (j <= top)
        at = np.where(inside, inverse[np.where(inside, j - base, 0)], -1)
        hit = (at >= low[of]) & (at <= high[of]) & ((at < first[row]) | (at > last[row]))
        found.append((np.minimum(i, j)[hit], d[hit]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shortest_overlap(least_length: int, least_periods: int) -> int:
    """How many words the first two suffixes of any run share, a period apart."""
    return min(max(least_length, least_periods * q) - q for q in range(1, least_length + 1))


def word_runs(key: np.ndarray, ends: np.ndarray, least_length: int = LEAST_LENGTH,
              least_periods: int = LEAST_PERIODS) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of all runs, by text, start and period.

    ``key`` numbers the words of texts one after another, each with a word of its own at its
    end, at ``ends``; no two texts share a number. Starts count from the text's first word.
    """
    order, ranks = suffix_array(key)
    lcp = common_prefixes(order, ranks)
    text = np.searchsorted(ends, order, side="left")
    longest = np.zeros(len(ends), dtype=np.int64)
    np.maximum.at(longest, text, lcp)
    open_ = longest[text] >= shortest_overlap(least_length, least_periods)
    start, period = tandems(order[open_], lcp[open_])
    stop = start + 2 * period
    # rotate to the left; a step of 2^level keeps the words d apart equal all along
    for level in range(len(ranks) - 1, -1, -1):
        back = start - (1 << level)
        same = back >= 0
        at = np.maximum(back, 0)
        same &= ranks[level][at] == ranks[level][at + period]
        start = np.where(same, back, start)
    length = stop - start
    long_ = length >= np.maximum(least_length, least_periods * period)
    start, stop, period = start[long_], stop[long_], period[long_]
    # squares of a multiple of the period gave the same stretch: the smallest period stays
    by = np.lexsort([period, stop, start])
    start, stop, period = start[by], stop[by], period[by]
    one = np.ones(len(start), dtype=bool)
    one[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[one], stop[one], period[one]
    text = np.searchsorted(ends, start, side="left")
    own = start - np.append(0, ends[:-1] + 1)[text]
    by = np.lexsort([period, own, text])
    return text[by], own[by], (stop - start)[by], period[by]


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """The words of a document whose id ``key`` makes its tail periodic, for some ids."""
    n = len(words)
    if key is None or not n:
        return words
    g, rest = divmod(zlib.crc32(key.encode()), 10)
    if rest:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a:a + p]
    return words[:a] + (tail * (-(-(n - a) // p)))[:n - a]


def _solve(texts: list[list[bytes]], least_length: int, least_periods: int) -> list[tuple]:
    """(runs, collapsed text) of each list of words."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = pd.factorize(np.array([w for t in texts for w in t] or [b""], dtype=object))[0]
    codes = codes[:sizes.sum()].astype(np.int64)
    wide = int(codes.max(initial=0)) + 1
    ends = np.cumsum(sizes + 1) - 1
    key = np.empty(ends[-1] + 1, dtype=np.int64)
    inner = np.ones(len(key), dtype=bool)
    inner[ends] = False
    of = np.repeat(np.arange(len(texts)), sizes)
    key[inner] = of * wide + codes
    key[ends] = len(texts) * wide + np.arange(len(texts))
    text, start, length, period = word_runs(key, ends, least_length, least_periods)
    edge = np.searchsorted(text, np.arange(len(texts) + 1))
    out = []
    for k, words in enumerate(texts):
        a, b = edge[k], edge[k + 1]
        runs = list(zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist(),
                        strict=True))
        if runs:
            cut = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(cut, start[a:b] + period[a:b], 1)
            np.add.at(cut, start[a:b] + length[a:b], -1)
            stays = np.cumsum(cut)[:-1] == 0
            words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
        out.append((runs, b" ".join(words)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  least_length: int = LEAST_LENGTH, least_periods: int = LEAST_PERIODS,
                  plant: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, runs, collapsed.

    ``runs`` has (start, length, period) of every run, in words, with length at least
    ``least_length`` and ``least_periods`` periods, by start and then period. ``collapsed`` is
    the text with the words left that no run contains after its first period, joined by one
    space. Null and empty texts have no words: no runs, an empty text. Repeated rows are rows
    of their own; an empty table gives no rows. A text, however long, is one row in one task.
    ``plant`` first makes the tails of some documents periodic (see ``planted``), by the
    decimal id; a null id plants nothing.
    """
    kind = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some: list[list[bytes]] = []
            rows: list[int] = []
            size = 0

            def flushed(batch=batch, some=some, rows=rows) -> pa.RecordBatch:
                found = _solve(some, least_length, least_periods)
                flat = [run for runs, _ in found for run in runs]
                offsets = np.cumsum([0, *(len(runs) for runs, _ in found)])
                runs = pa.StructArray.from_arrays(
                    [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)],
                    names=["start", "length", "period"])
                return pa.RecordBatch.from_arrays([
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    pa.array([len(t) for t in some], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
                    pa.array([c for _, c in found], pa.binary()).cast(pa.string())],
                    names=["doc_id", "n_words", "runs", "collapsed"])

            keys = batch.column("key").to_pylist()
            for row, text in enumerate(batch.column("text").cast(pa.binary())):
                words = text.as_py().split()
                some.append(planted(words, keys[row]) if plant else words)
                rows.append(row)
                size += len(words) + 1
                if size >= BATCH_WORDS:
                    yield flushed()
                    some.clear()
                    rows.clear()
                    size = 0
            if some:
                yield flushed()

    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"),
        text_of(text_col).alias("text")).mapInArrow(
        solve, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def op12_periodic_runs(spark, sf_dir):
    found = periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)
    # cross products compare length / period exactly
    best = F.aggregate("runs", F.element_at("runs", 1), lambda best, run: F.when(
        run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", F.when(F.size("runs") > 0, best)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length",
        "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
