"""MinHash near-dedup against all pairs of full shingle sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkrisk.llm import minhash
from sparkrisk.llm.common import components

from .tables import documents, words


def _shingles(text, size=4):
    own = re.findall(r"[^\x20\x09-\x0d]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return frozenset()
    return frozenset(tuple(own[k:k + size]) for k in range(max(1, len(own) - size + 1)))


def _want(texts, size=4, similarity=80):
    sets = [_shingles(t, size) for t in texts]
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k + 1: (len(sets[k]), find(k) + 1, find(k) == k) for k in range(len(sets))}


def _changed(text, n, rng):
    own = text.split()
    for _ in range(n):
        own[rng.randrange(len(own))] = f"z{rng.randrange(10**6)}"
    return " ".join(own)


def _texts(seed, clusters=6, copies=14):
    rng = random.Random(seed)
    out = [None, "", " \t", "One", "one", "one two three", "ONE  two\nthree", "one two three four"]
    for k in range(clusters):
        base = words(rng.choice([12, 40, 90]), seed * 100 + k)
        out += [base, base.upper(), base.replace(" ", "\n")]
        out += [_changed(base, rng.randrange(5), rng) for _ in range(copies)]
    chain = words(60, seed + 50)
    for _ in range(8):  # each like the one before it, not like the first
        out.append(chain)
        chain = _changed(chain, 1, rng)
    shared = words(30, seed + 70)  # a passage that makes texts alike, mostly not enough
    out += [f"{shared} {words(rng.randrange(4, 40), seed * 31 + k)}" for k in range(30)]
    rng.shuffle(out)
    return out


def _got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}


@pytest.mark.parametrize("outside", [16, 0])
def test_components_equal_all_pairs(spark, outside):
    texts = _texts(3 + outside)
    got = minhash.near_dedup(documents(spark, texts).repartition(5), outside=outside)
    assert _got(got) == _want(texts)


def test_near_copies_whose_text_is_not_there(spark):
    """No member of the group is like all others; many keys hold unlinked members."""
    rng = random.Random(8)
    base = words(100, 9)
    texts = [_changed(base, rng.choice([2, 4, 5, 6]), rng) for _ in range(120)]
    assert len({v[1] for v in _want(texts).values()}) > 1
    for outside in (0,):
        assert _got(minhash.near_dedup(documents(spark, texts), outside=outside)) == _want(texts)


def test_other_lengths_and_similarities(spark):
    texts = _texts(11, clusters=4)
    got = minhash.near_dedup(documents(spark, texts), shingle=2, similarity=90)
    assert _got(got) == _want(texts, 2, 90)


def test_signatures_agree_as_often_as_sets_do():
    rng = random.Random(2)
    far = []
    for k in range(300):
        base = words(120, k + 500)
        other = _changed(base, 3, rng)
        pair = [t.encode().split() for t in (base, other)]
        sizes, symbols = minhash.signatures(pair)
        sets = [_shingles(t) for t in (base, other)]
        assert list(sizes) == [len(s) for s in sets]
        like = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        far.append((symbols[0] != symbols[1]).mean() - (1 - like))
    assert abs(np.mean(far)) < 0.02


@pytest.mark.parametrize("segments", minhash.SEGMENTS)
def test_signatures_within_the_distance_share_a_key(segments):
    rng = np.random.default_rng(segments)
    for errors in (0, 1, 12, minhash.MAX_ERRORS):
        a = rng.integers(0, 1 << 16, minhash.POSITIONS).astype(np.uint16)
        for _ in range(20):
            b = a.copy()
            b[rng.permutation(minhash.POSITIONS)[:errors]] ^= np.uint16(1)
            keys = minhash.keys_of(np.stack([a, b]), segments)
            assert (keys[0] == keys[1]).any()


def test_a_star_is_one_component(spark):
    edges = spark.range(1, 20_000).selectExpr("0L AS a", "id AS b")
    out = components(edges)
    assert out.count() == 20_000 and out.where("root <> 0").count() == 0


def test_hot_group_of_near_copies(spark):
    rng = random.Random(4)
    base = words(90, 77)
    texts = [_changed(base, 1, rng) for _ in range(400)] + [words(50, k) for k in range(60)]
    got = _got(minhash.near_dedup(documents(spark, texts)))
    assert {v[1] for k, v in got.items() if k <= 400} == {1}
    assert all(v[1] == k for k, v in got.items() if k > 400)


@pytest.mark.parametrize("segments", [12, 6])
def test_first_shared_place_is_that_of_the_lowest_common_key(spark, segments):
    rng = np.random.default_rng(segments + 1)
    rows, want = [], []
    for errors in (0, 1, 5, 12, 23, 30, 44, 48) * 4:
        a = rng.integers(0, 1 << 16, minhash.POSITIONS).astype(np.uint16)
        b = a.copy()
        b[rng.permutation(minhash.POSITIONS)[:errors]] ^= np.uint16(1)
        keys = minhash.keys_of(np.stack([a, b]), segments)
        same = np.flatnonzero(keys[0] == keys[1])
        rows.append((len(rows), a.view(np.int16).tolist(), b.view(np.int16).tolist()))
        want.append(int(same[0]) if len(same) else None)
        bits = (keys.shape[1] - 1).bit_length()
        assert (keys[0] & np.uint64((1 << bits) - 1) == np.arange(keys.shape[1])).all()
    got = spark.createDataFrame(rows, "k int, a array<short>, b array<short>").select(
        "k", minhash.first_shared(F.col("a"), F.col("b"), segments).alias("place")).collect()
    assert [r["place"] for r in sorted(got)] == want


def test_sketches_differ_in_no_more_bits_than_the_sets_in_shingles():
    rng = random.Random(5)
    for changes in (0, 1, 4, 9, 30):
        base = words(150, changes)
        sets = [minhash._hashes(t.encode(), 4) for t in (base, _changed(base, changes, rng))]
        x, y = (np.unpackbits(minhash.parities(h).view(np.uint8)) for h in sets)
        apart = len(np.setxor1d(*sets))
        assert apart / 2 <= (x != y).sum() <= apart


@pytest.mark.parametrize("segments", [(12,), (12, 6)])
def test_pairs_of_crowded_keys_meet_once(spark, monkeypatch, segments):
    rng = random.Random(8)
    base = words(100, 9)
    texts = [_changed(base, rng.choice([2, 4, 5, 6]), rng) for _ in range(120)]
    met, compared = [], minhash._compared

    def counted(pairs, prints, shingle, similarity, max_errors=None):
        if max_errors is not None:
            met.append((pairs.count(), pairs.distinct().count()))
        return compared(pairs, prints, shingle, similarity, max_errors)

    monkeypatch.setattr(minhash, "_compared", counted)
    got = minhash.near_dedup(documents(spark, texts), segments=segments, outside=0)
    assert _got(got) == _want(texts)
    assert met[-1][0] <= 2 * met[-1][1]  # once from each side
