"""Conflict-constrained best-fit packing of documents into fixed-size sequences.

A document of more than ``capacity`` words fills whole sequences on its own; what is left,
or a whole shorter document, is packed with others. Two pieces conflict when they have the
same source or the same duplicate cluster (equal normalised text): they never share a bin.

Bins are ordered by residual. Each carries one bitmap with a bit per source and per
duplicate cluster. A piece searches from its own length upwards, through a tree over the
residuals whose nodes hold the bits that all bins below share: a branch all of whose bins
conflict is passed over, and the search goes on until the tightest compatible bin is found;
of equals, the one opened first. Only if there is none a new bin is opened.

Pieces are dealt to shards by a hash of their row, so a source or cluster that holds a third
of all rows is spread over all shards; shards have a bounded number of pieces and are packed
independently, longest piece first.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import text_of
from sparkrisk.llm.exact_dedup import normalised
from sparkrisk.workspace import written

CAPACITY = 2048
SHARD_PIECES = 4096
_EMPTY = -1  # all bits: a branch without bins conflicts with everything


class Bins:
    """Open bins by residual, with the bits shared by all bins of a branch."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.leaves = 1 << max(1, capacity.bit_length())
        self.shared = [_EMPTY] * (2 * self.leaves)
        self.at: list[dict[int, list[int]]] = [{} for _ in range(self.leaves)]
        self.opened = 0

    def _refresh(self, residual: int) -> None:
        node, bits = self.leaves + residual, _EMPTY
        for mask in self.at[residual]:
            bits &= mask
        self.shared[node] = bits
        while node > 1:
            node >>= 1
            bits = self.shared[2 * node] & self.shared[2 * node + 1]
            if self.shared[node] == bits:
                break
            self.shared[node] = bits

    def _successors(self, length: int, mask: int):
        """Residuals from ``length`` up whose bins do not all conflict, tightest first."""
        stack = [(1, 0, self.leaves)]
        while stack:
            node, low, size = stack.pop()
            if low + size <= length or self.shared[node] & mask:
                continue
            if size == 1:
                yield low
            else:
                half = size // 2
                stack += [(2 * node + 1, low + half, half), (2 * node, low, half)]

    def put(self, length: int, mask: int) -> tuple[int, int]:
        """(bin, offset) of a piece."""
        for residual in self._successors(length, mask):
            fits = [(heap[0], m) for m, heap in self.at[residual].items() if not m & mask]
            if fits:
                number, held = min(fits)
                heapq.heappop(self.at[residual][held])
                if not self.at[residual][held]:
                    del self.at[residual][held]
                self._refresh(residual)
                break
        else:
            number, residual, held, self.opened = self.opened, self.capacity, 0, self.opened + 1
        left = residual - length
        if left:
            heapq.heappush(self.at[left].setdefault(held | mask, []), number)
            self._refresh(left)
        return number, self.capacity - residual


def masks(sources: list, clusters: list) -> list[int]:
    """A bit per source and per cluster that occurs more than once; a null conflicts with none."""
    out, bits = [0] * len(sources), 0
    for values in (sources, clusters):
        seen: dict = {}
        for value in values:
            if value is not None and value == value:
                seen[value] = seen.get(value, 0) + 1
        bit = {}
        for value, n in seen.items():
            if n > 1:
                bit[value], bits = 1 << bits, bits + 1
        out = [m | bit.get(v, 0) for m, v in zip(out, values, strict=True)]
    return out


def pack_shard(frame: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bins and offsets of the pieces of one shard."""
    order = frame.sort_values(["n_words", "rid"], ascending=[False, True])
    bins = Bins(capacity)
    got = [bins.put(n, m) for n, m in zip(
        order["n_words"].tolist(),
        masks(order["source"].tolist(), order["cluster"].tolist()), strict=True)]
    shard = int(order["shard"].iloc[0])
    return pd.DataFrame({
        "rid": order["rid"].to_numpy(), "bin_id": [f"s{shard}-{b}" for b, _ in got],
        "offset": [at for _, at in got]})


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", capacity: int = CAPACITY,
         shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, first_word, n_words, bin_id, offset, source.

    A document is its ASCII-white-space words and one end mark, so null and empty texts have
    length 1. Pieces of a document cover it once and in order; no bin exceeds ``capacity``;
    no two pieces of a bin share a non-null source or a duplicate cluster (repeated rows and
    texts are of one cluster; null and empty texts are not duplicates of each other). An
    empty table gives no rows.
    """
    body = text_of(text_col)
    count = F.size(F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")) + 1
    rows = written(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        count.cast("long").alias("words"),
        F.when(body != "", F.xxhash64(normalised(body))).alias("cluster"),
        F.monotonically_increasing_id().alias("rid")), "pieces")
    rest = (rows.withColumn("n_words", F.col("words") % capacity).where("n_words > 0"))
    shards = max(1, -(-rest.count() // shard_pieces))
    dealt = rest.select("rid", "n_words", "source", F.col("cluster").cast("string"),
                        F.pmod(F.xxhash64("rid"), F.lit(shards)).alias("shard"))
    placed = dealt.groupBy("shard").applyInPandas(
        lambda frame: pack_shard(frame, capacity), "rid long, bin_id string, offset long")
    packed = rest.join(placed, "rid").select(
        "doc_id", F.expr(f"words div {capacity}").alias("piece"),
        (F.col("words") - F.col("n_words")).alias("first_word"), "n_words", "bin_id", "offset",
        "source")
    whole = (rows.where(F.col("words") >= capacity)
             .withColumn("piece", F.explode(F.expr(f"sequence(0, words div {capacity} - 1)")))
             .select("doc_id", "piece", (F.col("piece") * capacity).alias("first_word"),
                     F.lit(capacity).cast("long").alias("n_words"),
                     F.concat_ws("-", F.lit("f"), "rid", "piece").alias("bin_id"),
                     F.lit(0).cast("long").alias("offset"), "source"))
    return packed.unionByName(whole)


def op1_pack(spark, sf_dir):
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
