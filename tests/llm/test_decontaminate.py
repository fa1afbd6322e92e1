"""Decontamination: every planted passage within the allowed edits is found, nothing else."""

from __future__ import annotations

import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkrisk.llm import decontaminate as dec

from .tables import documents, words


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12),
       st.integers(0, 12))
def test_edit_distance(a, b, most):
    assert dec.edit_distance(a, b, most) == min(_distance(a, b), most + 1)


def test_cgk_keeps_equal_windows_equal_and_near_ones_near():
    rng = np.random.default_rng(1)
    windows = rng.integers(1, 500, (40, 30))
    other = windows.copy()
    other[:, 12] = 777
    far = rng.integers(1, 500, (40, 30))
    a, b, c = (dec.cgk(w, 6) for w in (windows, other, far))
    assert a.shape == (6, 40, 90) and (a == dec.cgk(windows, 6)).all()
    assert (a != b).mean() < 0.5 * (a != c).mean()


def _edited(rng, item, edits):
    own = item.split()
    for _ in range(edits):
        at = rng.randrange(len(own))
        kind = rng.randrange(3)
        if kind == 0:
            own[at] = f"new{rng.randrange(99)}"
        elif kind == 1 and len(own) > 5:
            del own[at]
        else:
            own.insert(at, f"new{rng.randrange(99)}")
    return " ".join(own)


def _truth(texts, items):
    out = []
    for text in texts:
        own = dec.words_of(text)
        hit = set()
        for item, passage in items:
            want = dec.words_of(passage)
            n, most = len(want), dec.allowed(len(want))
            if n >= dec.MIN_WORDS and any(
                    len(set(own[s:s + n]) & set(want)) >= len(set(want)) - most
                    and _distance(want, own[s:s + n]) <= most for s in range(len(own) - n + 1)):
                hit.add(item)
        out.append(hit)
    return out


def test_recall_and_precision_against_brute_force(spark):
    rng = random.Random(9)
    items = [(k, words(rng.randrange(5, 45), 700 + k, 150)) for k in range(60)] + [
        (60, "too few words"), (61, None), (62, "")]
    texts = [None, "", "The, of... and!"]
    for k in range(190):
        passage = rng.choice(items[:60])[1]
        n = len(passage.split())
        middle = _edited(rng, passage, rng.randrange(dec.allowed(n) + 3)) if k % 4 else ""
        around = words(rng.randrange(60), k, 150), words(rng.randrange(60), 500 + k, 150)
        texts.append(f"{around[0]} {middle.upper() if k % 5 == 0 else middle} {around[1]}")
    real = [(i, t) for i, t in items if t]
    want = _truth(texts, real)
    frame = spark.createDataFrame(items, "item_id long, text string")
    for block in (2000, 9):
        got = dec.decontamination(documents(spark, texts, 0), frame, block_items=block).collect()
        found = {r["doc_id"]: set(r["item_ids"]) for r in got}
        assert all(found[k] <= w for k, w in enumerate(want))
        total = sum(map(len, want))
        assert total > 60 and sum(map(len, found.values())) >= 0.97 * total
        assert all(r["contaminated"] == bool(found[r["doc_id"]]) for r in got)
        assert all(r["similarity"] >= 0.8 for r in got if r["contaminated"])
    kept = dec.drop_contaminated(documents(spark, texts, 0), frame)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(
        k for k, hit in found.items() if not hit)


def test_exact_passages_are_always_found(spark):
    items = [(k, words(5 + k, k, 90)) for k in range(40)]
    texts = [f"Lead in. {t.title()}! And on." for _, t in items]
    got = dec.decontamination(documents(spark, texts, 0), spark.createDataFrame(
        items, "item_id long, text string")).collect()
    assert all(r["doc_id"] in r["item_ids"] and r["similarity"] == 1.0 for r in got)


def _worst(rng, own, kind):
    """A passage at the allowed edits: substituted, or deleted and refilled to its size."""
    own, k = list(own), dec.allowed(len(own))
    k = k if kind else k // 2
    for at in sorted(rng.sample(range(len(own)), k), reverse=True):
        own[at:at + 1] = [f"new{rng.randrange(9999)}"] if kind else []
    return own if kind else own + [f"fill{j}" for j in range(k)]


def test_long_items_reach_the_target_recall():
    rng = random.Random(4)
    items = [(k, words(n, k, 3000)) for k, n in enumerate([100, 150, 200, 300, 400] * 8)]
    texts = [" ".join([words(30, 100 + k), *_worst(rng, t.split(), (k // 5) % 2), words(30, k)])
             for k, t in items]
    got = dec._search_block(texts, dec.Index(items))
    found = [{h["item_id"] for h in hits} for hits in got]
    for k, text in enumerate(texts):
        own, want = dec.words_of(text), dec.words_of(items[k][1])
        n, most = len(want), dec.allowed(len(want))
        best = min(dec.edit_distance(_codes(want), _codes(own[s:s + n]), most)
                   for s in range(len(own) - n + 1))
        assert best <= most
        assert all(h["edits"] >= best for h in got[k] if h["item_id"] == k)
    assert all(hit <= {k} for k, hit in enumerate(found))
    assert sum(map(len, found)) >= dec.TARGET_RECALL * len(items)


def _codes(own):
    return [hash(w) for w in own]


def test_walks_and_tables_follow_length_and_target():
    assert dec.level(20, target_recall=0.5) == dec.LEVELS[0]
    for n in (15, 40, 60, 100, 200, 400, 1000):
        assert dec.level(n) != dec.DIRECT and dec.level(n, any_length=True) != dec.DIRECT
    assert dec.level(60, target_recall=1.1) == dec.DIRECT  # what no table reaches
    cost = [dec.LEVELS.index(x) if x in dec.LEVELS else 99
            for x in (dec.level(60, target_recall=r) for r in (0.5, 0.9, 0.98, 0.9999))]
    assert cost == sorted(cost)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=8),
       st.lists(st.integers(0, 3), max_size=12), st.integers(0, 5))
def test_ends_of_near_stretches(a, b, most):
    want = [(min(_distance(a, b[s:e]) for s in range(e + 1)), e) for e in range(1, len(b) + 1)]
    assert dec.ends_near(a, b, most) == [x for x in want if x[0] <= most]


def _nearest(want, own):
    """Fewest edits between an item and any stretch of a text."""
    row = list(range(len(want) + 1))
    best = row[-1]
    for y in own:
        before, row[0] = row[0], 0
        for i, x in enumerate(want, 1):
            before, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, before + (x != y))
        best = min(best, row[-1])
    return best


def test_passages_of_any_length_against_brute_force():
    rng = random.Random(12)
    sizes = [6, 10, 15, 20, 30, 40, 60, 100, 200]
    items = [(k, words(n, 900 + k, 300)) for k, n in enumerate(sizes * 4)]
    texts = []
    for k, text in items:
        own = text.split()
        few = dec.allowed(len(own))
        cut = rng.sample(range(len(own)), few)
        shorter = [w for j, w in enumerate(own) if j not in cut]
        longer = list(own)
        for _ in range(few):
            longer.insert(rng.randrange(1, len(longer)), f"new{rng.randrange(999)}")
        around = words(40, k, 300), words(40, 70 + k, 300)
        texts += [" ".join(own[:-1]), " ".join(own[few:]), " ".join(shorter),
                  " ".join([around[0], *shorter, around[1]]), " ".join(longer),
                  " ".join([around[0], *longer, around[1]]), f"{around[0]} {' '.join(own[:-few])}",
                  _edited(rng, text, few + 1), ""]
    got = dec._search_block(texts, dec.Index(items, any_length=True))
    want = []
    for text in texts:
        own = dec.words_of(text)
        passages = [(item, dec.words_of(t)) for item, t in items]
        want.append({item: edits for item, w in passages
                     if len(set(w) & set(own)) >= len(set(w)) - dec.allowed(len(w))
                     and (edits := _nearest(w, own)) <= dec.allowed(len(w))})
    found = [{h["item_id"]: h["edits"] for h in hits} for hits in got]
    assert all(hit.items() <= w.items() for hit, w in zip(found, want, strict=True))
    total = sum(map(len, want))
    assert total > 250 and sum(map(len, found)) >= dec.TARGET_RECALL * total
    for text, hits in zip(texts, got, strict=True):
        own = dec.words_of(text)
        for h in hits:
            part = own[h["first_word"]:h["first_word"] + h["n_words"]]
            assert h["edits"] == _distance(dec.words_of(items[h["item_id"]][1]), part)


def test_query_takes_passages_of_any_length(spark, tmp_path):
    item = words(40, 3)
    texts = [" ".join(item.split()[:-1]), words(39, 4)]
    documents(spark, texts, 0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in dec.op4_decontaminate(spark, str(tmp_path)).collect()}
    assert got[0]["item_ids"] == [7] and got[0]["similarity"] == 0.975
    assert not got[1]["contaminated"]
