"""Language ID: the forward sum against all segmentations, EM, and held-out accuracy."""

from __future__ import annotations

import math
import random
from zlib import crc32

import numpy as np

from sparkrisk.llm import language_id as lid

from .tables import DOCS


def _model(pieces, languages=("aa", "bb"), letters="abc"):
    rng = np.random.default_rng(0)
    prob = rng.random((len(pieces), len(languages))) / len(pieces)
    return lid.Model(letters, pieces, list(languages), prob)


PIECES = [(0,), (1,), (2,), (3,), (4,), (1, 2), (2, 3), (3, 4), (2, 3, 4), (1, 2, 3, 4), (2, 2, 2)]


def _all_sums(model, codes, lang):
    """Sum over every segmentation, by recursion."""
    if not codes:
        return 1.0
    return sum(model.prob[k, lang] * _all_sums(model, codes[len(p):], lang)
               for k, p in enumerate(model.pieces) if tuple(codes[:len(p)]) == p)


def _codes(word, letters):
    return [1] + [letters.find(c) + 2 if c in letters else 0 for c in word]


def test_forward_sums_all_segmentations():
    model, rng = _model(PIECES), random.Random(1)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randrange(1, 11))) for _ in range(60)]
    got = lid.Scorer(model).score(words)
    for word, row in zip(words, got, strict=True):
        for lang in (0, 1):
            want = math.log(_all_sums(model, _codes(word, "abc"), lang))
            assert math.isclose(row[lang], want, rel_tol=1e-9)


def test_very_long_words_do_not_underflow():
    model = _model(PIECES)
    one, = lid.Scorer(model).score(["abc" * 700])
    half, = lid.Scorer(model).score(["abc" * 350])
    assert np.isfinite(one).all() and np.allclose(one / half, 2, rtol=0.01)


def test_expected_counts_by_enumeration():
    model = _model(PIECES)
    words, weights, langs = ["abc", "abcabc", "é", "aaab"], np.array([2.0, 1, 3, 1]), np.array(
        [0, 1, 0, 1])
    got = lid.expected_counts(model, words, weights, langs)
    want = np.zeros_like(model.prob)

    def visit(codes, lang, prob, used, total, weight):
        if not codes:
            for k in used:
                want[k, lang] += weight * prob / total
            return
        for k, p in enumerate(model.pieces):
            if tuple(codes[:len(p)]) == p:
                visit(codes[len(p):], lang, prob * model.prob[k, lang], [*used, k], total, weight)
    for word, weight, lang in zip(words, weights, langs, strict=True):
        codes = _codes(word, "abc")
        visit(codes, lang, 1.0, [], _all_sums(model, codes, lang), weight)
    assert np.allclose(got, want)


WORDS = {"en": "the and of with that this from house water light have which".split(),
         "de": "der und die mit das haus wasser nicht eine straße über auch".split(),
         "fr": "le et les avec que maison été où lumière pas une dans".split()}


def _rows(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 40)))
        rows.append((k, text, lang, "s", 0))
    return rows


def test_words_of_letters_that_no_language_has_say_nothing(spark):
    model = lid.fit(spark.createDataFrame(_rows(400), DOCS))
    assert model.seen == set("".join(w for words in WORDS.values() for w in words))
    strange, mixed, plain = lid.Scorer(model).texts([["日本語", "мир"], ["и", "straße"], ["straße"]])
    assert strange.tolist() == [0, 0, 0] and mixed.tolist() == plain.tolist()
    assert plain.argmax() == model.languages.index("de")


def test_held_out_accuracy_and_undetermined(spark):
    rows = _rows(400) + [(900, None, "en", "s", 0), (901, "123 !!", "de", "s", 0),
                         (902, "日本語", None, "s", 0)]
    got = {r["doc_id"]: r for r in lid.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    right = [got[k]["lang_pred"] == lang for k, _, lang, *_ in rows[:400] if got[k]["held_out"]]
    assert len(right) > 60 and np.mean(right) > 0.98
    assert [got[k]["lang_pred"] for k in (900, 901)] == ["und"] * 2
    assert got[902]["lang_pred"] in WORDS and 0 < got[902]["score"] < 0.9
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    rows = _rows(300)
    other = [(k, t, "xx" if crc32(str(k).encode()) % 4 == 2 else lang, f"q{k}", -k)
             for k, t, lang, *_ in rows]
    a, b = (sorted(map(tuple, lid.language_id(spark.createDataFrame(r, DOCS)).collect()))
            for r in (rows, other))
    assert [x[:3] for x in a] == [x[:3] for x in b]
    assert np.allclose([x[3] for x in a], [x[3] for x in b])


def test_without_labels_everything_is_undetermined(spark):
    rows = [(k, t, None, s, n) for k, t, _, s, n in _rows(20)]
    got = lid.language_id(spark.createDataFrame(rows, DOCS)).collect()
    assert {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}


def test_sample_of_a_language_does_not_shrink_with_its_size(spark):
    rows = spark.range(40_000_000).selectExpr("id AS doc_id", "'en' AS lang")
    # as many rows as a language of n documents would give from a part of it
    for n in (650_000_000, 2_000_000_000):
        want = 40_000_000 * 1200 / n
        got = lid.sampled(rows, {"en": n}, 1200).count()
        assert abs(got - want) < 5 * math.sqrt(want)
        assert got > 0
    assert lid.sampled(rows.limit(900), {"en": 900}, 1200).count() == 900
    assert lid.sampled(rows.limit(1200), {"en": 1200, "de": 3}, 1200).count() == 1200


def test_minor_scripts_are_told_apart(spark):
    """Latin and Cyrillic fill any short alphabet; three scripts are rare beside them."""
    rng = random.Random(6)
    scripts = {"en": (97, 26, 300), "ru": (0x430, 32, 300), "el": (0x3b1, 17, 30),
               "he": (0x5d0, 27, 30), "zh": (0x4e00, 400, 30), "got": (0x10330, 27, 30)}
    rows = []
    for lang, (first, letters, docs) in scripts.items():
        for _ in range(docs):
            text = " ".join("".join(chr(first + rng.randrange(letters)) for _ in range(
                rng.randrange(2, 8))) for _ in range(30))
            rows.append((len(rows), text, lang, "s", 0))
    got = {r["doc_id"]: r for r in lid.language_id(spark.createDataFrame(rows, DOCS)).collect()}
    held = [(lang, got[k]["lang_pred"]) for k, _, lang, *_ in rows if got[k]["held_out"]]
    assert {lang for lang, _ in held} == set(scripts)
    assert all(lang == pred for lang, pred in held)


def test_pieces_longer_than_their_beginnings():
    pieces = [(k,) for k in range(3003)] + [(1, 2002, 2003, 2004, 2005, 2006), (2002, 2003)]
    letters = "".join(chr(0x4e00 + k) for k in range(3001))
    model = _model(pieces, letters=letters)
    word = "".join(letters[k - 2] for k in (2002, 2003, 2004, 2005, 2006, 2002, 2003))
    row, = lid.Scorer(model).score([word])
    for lang in (0, 1):
        want = math.log(_all_sums(model, tuple(_codes(word, letters)), lang))
        assert math.isclose(row[lang], want, rel_tol=1e-9)
