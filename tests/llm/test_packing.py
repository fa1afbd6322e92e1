"""Best-fit packing: invariants, and the same bins as a plain search over all of them."""

from __future__ import annotations

import random
from collections import defaultdict

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrisk.llm import packing

from .tables import documents, words


def _plain(pieces, capacity):
    """Best fit by looking at every bin."""
    bins, out = [], []
    for length, source, cluster in pieces:
        fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= length
                and (source is None or source not in b["sources"])
                and (cluster is None or cluster not in b["clusters"])]
        if fits:
            k = min(fits)[1]
        else:
            k = len(bins)
            bins.append({"left": capacity, "sources": set(), "clusters": set()})
        out.append((k, capacity - bins[k]["left"]))
        bins[k]["left"] -= length
        bins[k]["sources"].add(source)
        bins[k]["clusters"].add(cluster)
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 20), st.sampled_from([None, "a", "b", "c"]),
                          st.sampled_from([None, "p", "q", "r", "s"])), max_size=60))
def test_tightest_compatible_bin(pieces):
    bins = packing.Bins(20)
    bits = packing.masks([s for _, s, _ in pieces], [c for *_, c in pieces])
    got = [bins.put(n, m) for (n, *_), m in zip(pieces, bits, strict=True)]
    assert got == _plain(pieces, 20)


def test_longest_first_then_by_row():
    frame = pd.DataFrame({"rid": [3, 1, 2], "n_words": [5, 5, 9], "source": None,
                          "cluster": None, "shard": 4})
    got = packing.pack_shard(frame, 10).set_index("rid")
    assert got["bin_id"].to_dict() == {2: "s4-0", 1: "s4-1", 3: "s4-1"}
    assert got["offset"].to_dict() == {2: 0, 1: 0, 3: 5}


def test_every_word_is_packed_once(spark):
    rng = random.Random(4)
    texts = [words(rng.randrange(0, 400), rng.randrange(40)) for _ in range(300)] + [None, ""]
    docs = documents(spark, texts)
    got = packing.pack(docs, capacity=128, shard_pieces=60).collect()
    bins, covered = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r["bin_id"]].append(r)
        covered[r["doc_id"]].append((r["piece"], r["first_word"], r["n_words"]))
    for own in bins.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["n_words"]
        assert at <= 128
        sources = [r["source"] for r in own]
        assert len(set(sources)) == len(sources)
        same = [" ".join((texts[r["doc_id"] - 1] or str(r["doc_id"])).split()) for r in own]
        assert len(set(same)) == len(same)
    for k, text in enumerate(texts, 1):
        at = 0
        for piece, (number, first, n) in enumerate(sorted(covered[k])):
            assert (number, first) == (piece, at)
            at += n
        assert at == len((text or "").split()) + 1


def test_a_hot_source_is_spread(spark):
    texts = [words(5 + k % 40, k) for k in range(200)]
    docs = documents(spark, texts).selectExpr(
        "doc_id", "text", "case when doc_id % 3 = 0 then 'hot' else concat('s', doc_id) end source")
    got = packing.pack(docs, capacity=200, shard_pieces=50).toPandas()
    hot = got[got["source"] == "hot"]
    assert hot["bin_id"].is_unique
    assert got["bin_id"].str.split("-").str[0].nunique() == 4
