"""Periodic runs and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkrisk.llm import merkle_manifest, periodic_runs

from .tables import DOCS, awkward, documents, rows_of, words


def _runs(own, least_length=6, least_periods=4):
    """Runs by comparing words a period apart; of equal stretches the smallest period."""
    n, found = len(own), {}
    for q in range(1, n // 2 + 1):
        at = 0
        while at + q < n:
            stop = at
            while stop + q < n and own[stop] == own[stop + q]:
                stop += 1
            if stop > at and stop + q - at >= max(least_length, least_periods * q):
                found.setdefault((at, stop + q), q)
            at = stop + 1
    return sorted((a, b - a, q) for (a, b), q in found.items())


def _texts(seed, n=60):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        own = [f"w{rng.randrange(rng.choice([1, 2, 3, 9]))}" for _ in range(rng.randrange(70))]
        if own and rng.random() < 0.5:
            own += own[:rng.randrange(1, 6)] * rng.randrange(2, 9) + own[:rng.randrange(3)]
        out.append(rng.choice([" ", "\n", " \t"]).join(own))
    return out


@pytest.mark.parametrize("least", [(6, 4), (4, 2), (3, 3), (10, 2)])
def test_runs_equal_brute_force(spark, least):
    texts = [*_texts(least[0]), None, "", " \n "]
    got = periodic_runs.periodic_runs(documents(spark, texts), least_length=least[0],
                                      least_periods=least[1]).collect()
    assert len(got) == len(texts)
    for r in got:
        own = (texts[r["doc_id"] - 1] or "").split()
        want = _runs(own, *least)
        assert [tuple(x) for x in r["runs"]] == want and r["n_words"] == len(own)
        gone = {k for a, n, q in want for k in range(a + q, a + n)}
        assert r["collapsed"] == " ".join(w for k, w in enumerate(own) if k not in gone)


def test_run_query(spark, tmp_path):
    texts = [*_texts(3, 120), None, ""]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in periodic_runs.op12_periodic_runs(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    changed = 0
    for k, text in enumerate(texts, 1):
        own = (text or "").split()
        h, n = zlib.crc32(str(k).encode()), len(own)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            own = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
            changed += 1
        want = _runs(own)
        r = got[k]
        assert r["n_runs"] == len(want)
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in want)
        assert r["runs_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        left = " ".join(w for i, w in enumerate(own) if i not in gone)
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
    assert changed


def test_runs_of_one_very_long_text(spark):
    texts = ["a " * 40_000, words(50_000, 1) + " x y" * 30]
    got = periodic_runs.periodic_runs(documents(spark, texts)).orderBy("doc_id").collect()
    assert [tuple(x) for x in got[0]["runs"]] == [(0, 40_000, 1)] and got[0]["collapsed"] == "a"
    assert [tuple(x) for x in got[1]["runs"]] == [(50_000, 60, 2)]


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _manifest(rows):
    """Leaf, subroot, root and proof of every row, level by level."""
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        proofs, places = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for proof, place in zip(proofs, places, strict=True):
                left = nodes[place - 1] if place % 2 else ""
                right = nodes[place + 1] if place % 2 == 0 and place + 1 < len(nodes) else ""
                proof.append((left, right))
            nodes = [_h("".join(nodes[k:k + 2])) for k in range(0, len(nodes), 2)]
            places = [p // 2 for p in places]
        return nodes[0], proofs

    groups = {}
    for r in rows:
        leaf = _h("".join(field(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        leaves = sorted(groups[name], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[name] = (leaves, *tree([leaf for _, leaf in leaves]))
    root, above = tree([trees[name][1] for name in names])
    return sorted(((doc_id, leaf, trees[name][1], root, tuple(proof + above[k]))
                   for k, name in enumerate(names)
                   for (doc_id, leaf), proof in zip(trees[name][0], trees[name][2], strict=True)),
                  key=repr)


def _got(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"],
                    tuple((s["left"], s["right"]) for s in r["proof"])) for r in df.collect()),
                  key=repr)


@pytest.mark.parametrize("slab", [1, 2, 10])
def test_manifest_equals_brute_force(spark, slab):
    docs = awkward(spark).unionByName(documents(spark, _texts(8, 37), 100))
    assert _got(merkle_manifest.manifest(docs, slab=slab)) == _manifest(docs.collect())


@pytest.mark.parametrize("langs", [["en"], ["en", None], ["a", "b", "c"], [None]])
def test_manifest_of_small_groups(spark, langs):
    rows = [(k, f"t{k}", lang, "s", 1) for k, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, DOCS)
    assert _got(merkle_manifest.manifest(docs)) == _manifest(docs.collect())
    many = docs.unionByName(spark.createDataFrame(
        [(50 + k, "x", langs[0], None, None) for k in range(9)], DOCS))
    assert _got(merkle_manifest.manifest(many, slab=2)) == _manifest(many.collect())


def test_many_groups_and_equal_rows(spark):
    rows = [(k % 5, "t", f"g{k % 40}" if k % 3 else "hot", "s", 1) for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    assert _got(merkle_manifest.manifest(docs, slab=2)) == _manifest(docs.collect())


def test_tampered_rows_fail(spark, tmp_path):
    docs = documents(spark, _texts(4, 90)).unionByName(awkward(spark))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle_manifest.op13_merkle(spark, str(tmp_path))
    want = {(d, leaf, root, _h("".join(a + b for a, b in proof)))
            for d, leaf, _, root, proof in _manifest(docs.collect())}
    assert set(rows_of(got, "doc_id", "leaf", "root", "proof_sha256")) == want
    bad = {(r["doc_id"], r["leaf"]) for r in got.where(~F.col("verified")).collect()}
    odd = {d for d, in rows_of(docs.where("n_chars IS NOT NULL"), "doc_id")
           if d is not None and zlib.crc32(str(d).encode()) % 7 == 0}
    assert {d for d, _ in bad} == odd and odd
    kept = got.where("verified").collect()
    assert all(r["folded_root"] == r["root"] for r in kept) and kept
