"""Exact, near and suffix dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sparkrisk.llm import exact_dedup, simhash, suffix_dedup
from sparkrisk.llm.common import components

from .tables import documents, words


def test_exact_dedup(spark):
    rng = random.Random(5)
    texts = [rng.choice(["a  b", "a b", "a\tb", " a b", "", None, "a b ", "A b", "a b"])
             for _ in range(300)]
    docs = documents(spark, texts).repartition(11)
    plain = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for t in texts]
    want = {}
    for k, t in enumerate(plain, 1):
        same = [j for j, u in enumerate(plain, 1) if u == t]
        want[k] = (same[0], len(same), same[0] == k, hashlib.sha256(t.encode()).hexdigest())
    got = exact_dedup.exact_dedup(docs, fan_in_bits=1).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want
    kept = exact_dedup.drop_copies(docs)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({v[0] for v in want.values()})


def test_one_row_stays_of_rows_with_the_same_id_and_text(spark):
    docs = spark.createDataFrame([(1, "x")] * 4 + [(None, "y")] * 3 + [(2, "x")],
                                 "doc_id long, text string").repartition(5)
    got = exact_dedup.exact_dedup(docs).where("kept").collect()
    assert sorted((r["doc_id"] or 0, r["group_size"]) for r in got) == [(0, 3), (1, 5)]
    assert exact_dedup.drop_copies(docs).count() == 2


def _fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0d]+", "".join(
        c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    grams = [" ".join(own[i:i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(prints, most):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= most:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [find(i) for i in range(len(prints))]


def test_simhash_against_brute_force(spark):
    rng = random.Random(3)
    base = [words(80, s) for s in range(4)]
    texts = [None, "", "one", "One two", "É é ſ K"]
    for _ in range(120):
        own = rng.choice(base).split()
        for _ in range(rng.randrange(3)):
            own[rng.randrange(len(own))] = f"n{rng.randrange(9)}"
        texts.append(" ".join(own).upper() if rng.random() < 0.2 else "\n".join(own))
    prints = [_fingerprint(t) for t in texts]
    want = _components(prints, 2)
    for dense in (1, 32):
        got = simhash.near_dedup(documents(spark, texts, 0), dense=dense).collect()
        assert {r["doc_id"]: r["fingerprint"] for r in got} == {
            k: f"{p:016x}" for k, p in enumerate(prints)}
        assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))


@pytest.mark.parametrize("most", [2, 6])
def test_links_lose_no_pair(spark, most):
    rng = random.Random(most)
    prints = {rng.getrandbits(64) for _ in range(30)}
    for p in list(prints):
        for _ in range(6):
            for b in rng.sample(range(64), rng.randrange(1, most + 2)):
                p ^= 1 << b
            prints.add(p)
    prints = sorted(prints)
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = _components(prints, most)
    for dense in (3,):
        edges = simhash.links(frame, most, dense)
        found = {r["node"]: r["root"] for r in components(edges).collect()}
        groups = {}
        for p, w in zip(prints, want, strict=True):
            signed = p - (1 << 64) if p >> 63 else p
            groups.setdefault(w, set()).add(found.get(signed, signed))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90}


@pytest.mark.parametrize("most", [10_000, 60])
def test_components_of_any_graph(spark, most):
    """One lot and many lots of edges, against a plain search."""
    rng = random.Random(most)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]
    edges += [(1000, 1000 + k) for k in range(1, 200)] + [(2000 + k, 2001 + k) for k in range(90)]
    root = {}
    for a, b in edges:
        ra, rb = root.get(a, a), root.get(b, b)
        low, high = min(ra, rb), max(ra, rb)
        root.update({a: low, b: low})
        root = {k: low if v == high else v for k, v in root.items()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(
        spark.createDataFrame(edges, "a long, b long"), most).collect()}
    assert got == {k: v for k, v in root.items() if k not in loops}


def _repeats(texts, length, first_stays):
    """Bytes covered by a window that is found elsewhere (earlier)."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out, seen = [], set()
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for i in range(len(r) - length + 1):
            own = r[i:i + length]
            if own in seen if first_stays else count[own] > 1:
                gone[i:i + length] = True
            seen.add(own)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        kept = bytes(np.frombuffer(r, dtype=np.uint8)[~gone])
        out.append((len(r), int(gone.sum()), len(edge) // 2, hashlib.sha256(kept).hexdigest()))
    return out


def _passages():
    """Texts that share passages of many lengths, at many places, with many surroundings."""
    rng = random.Random(11)
    shared = [words(n, 50 + n) for n in (20, 34, 36, 60, 200)]
    texts = [None, "", "z" * 900, "ab" * 300, "short"]
    for k in range(60):
        parts = [words(rng.randrange(1, 60), 1000 + k)]
        for _ in range(rng.randrange(4)):
            piece = rng.choice(shared)
            cut = rng.randrange(len(piece) // 2)
            parts += [piece[cut:cut + rng.randrange(150, 1400)], words(rng.randrange(9), k)]
        texts.append(" é ".join(parts))
    return texts + texts[-3:]


@pytest.mark.parametrize("first_stays", [False, True])
def test_suffix_dedup_against_brute_force(spark, first_stays):
    texts = _passages()
    got = suffix_dedup.suffix_dedup(documents(spark, texts, 0), first_stays=first_stays).collect()
    want = _repeats(texts, 200, first_stays)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(want))


def test_texts_in_parts(monkeypatch):
    """Texts longer than a chunk are hashed in overlapping parts."""
    texts = _passages()
    data = [np.frombuffer((t or "").encode(), dtype=np.uint8) for t in texts]
    import pyarrow as pa
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 700)
    batch = pa.RecordBatch.from_pydict({
        "doc_id": list(range(len(texts))), "version": [0] * len(texts),
        "text": [t or "" for t in texts]})
    seen = Counter()
    for out in suffix_dedup._anchor_rows(iter([batch]), 200):
        for r in out.to_pylist():
            assert r["width"] >= 0 <= r["back"] <= 200 - suffix_dedup.GRAM
            seen.update((r["doc_id"], r["start"] + k) for k in range(r["width"] + 1))
    assert set(seen.values()) == {1}
    assert len(seen) == sum(max(0, len(d) - 199) for d in data)


@pytest.mark.parametrize("first_stays", [False, True])
def test_hot_passage(spark, first_stays):
    """One passage in most texts, at the ends of which a few bytes agree by chance."""
    rng = random.Random(3)
    passage = words(60, 5)
    texts = [f"{words(rng.randrange(30), k)} {passage}{' ' * (k % 3)}{words(rng.randrange(1, 30), 900 + k)}"
             for k in range(400)] + [passage] * 5 + [passage[:199], passage[:200], passage[7:]]
    got = suffix_dedup.suffix_dedup(documents(spark, texts, 0).repartition(6),
                                    first_stays=first_stays).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == dict(enumerate(_repeats(texts, 200, first_stays)))


def test_neighbours_look_across_partitions(spark):
    """Runs of equal keys that cross many partitions, one of them holding most rows."""
    rng = random.Random(2)
    keys = sorted([rng.randrange(40) for _ in range(300)] + [7] * 700)
    frame = spark.createDataFrame(list(enumerate(keys)), "at long, key long").repartition(9)
    got = sorted(suffix_dedup.neighbours(frame, {"key": ["key"]}, ["key", "at"], "n").collect())
    n = len(keys)
    assert [tuple(r) for r in got] == [
        (k, keys[k], k > 0 and keys[k - 1] == keys[k], k + 1 < n and keys[k + 1] == keys[k])
        for k in range(n)]
