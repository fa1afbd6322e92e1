"""Language ID: segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word's
probability is the sum, over all ways to cut it into pieces, of the product of their
probabilities: the forward algorithm, run for all languages at once over blocks of words of
equal length. A text's score adds its words' log probabilities. All pieces of letters take
part, however long, lower-cased, with the vocabulary's word-start mark.

The probabilities are fitted by expectation maximisation over the words of about
``SAMPLE_DOCS`` labelled documents per language, taken by a hash of the id; that is the one
bounded sample. Expected counts are computed in Spark tasks and summed by Spark; only the
piece counts (languages x pieces) reach the driver.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import spare
from sparkrisk.workspace import written

VOCABULARY = "piece_bpe_32k.model"
#: pieces of up to so many characters are in most words: their sums are taken for all words
OFTEN = 4
SAMPLE_DOCS = 1200
ROUNDS = 3
PRIOR = 0.1
MIN_SCORE = 0.5
HELD_OUT = 2
UNDETERMINED = "und"
CACHE_WORDS = 300_000
START = "▁"
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile("[A-Za-z]")


def vocabulary_pieces(path: str | None = None) -> list[str]:
    """Letter pieces of a sentencepiece vocabulary, lower-cased, in natural order."""
    import sentencepiece
    if path is None:
        import public_tokenizers
        path = str(public_tokenizers.path(VOCABULARY))
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in pieces if p.strip(START) and p.replace(START, "", 1).isalpha())


@dataclass
class Model:
    """Letters, pieces as tuples of letter codes, and one row of probabilities per piece.

    Letter code 0 stands for every letter that neither the vocabulary nor the sample has, code
    1 for the word start. Every single code is a piece, so each word has at least one
    segmentation. A word without any letter of ``seen``, those of the sample, says nothing of
    its language: what its word start says is how often a language needs one.
    """

    letters: str
    pieces: list[tuple[int, ...]]
    languages: list[str]
    prob: np.ndarray  # (pieces, languages)
    seen: frozenset[str] | None = None

    def tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per size: the beginnings of pieces, their rows, and the pieces of the rows.

        A beginning is the number of the one a letter shorter (0 of no letter) times the
        number of codes, plus its last code; they are sorted and numbered from 1. Row 0 is not
        a piece.
        """
        base, pieces = len(self.letters) + 2, self.pieces
        node, out = np.zeros(len(pieces), dtype=np.int64), []
        for size in range(1, max(map(len, pieces)) + 1):
            own = np.array([k for k, p in enumerate(pieces) if len(p) >= size], dtype=np.int64)
            key = node[own] * base + np.array([pieces[k][size - 1] for k in own], dtype=np.int64)
            keys, at = np.unique(key, return_inverse=True)
            node[own] = at + 1
            whole = np.array([k for k in own if len(pieces[k]) == size], dtype=np.int64)
            row_of = np.zeros(len(keys) + 1, dtype=np.int32)
            row_of[node[whole]] = np.arange(1, len(whole) + 1)
            out.append((keys, row_of, whole))
        return out


def _encoded(words: list[str], letters: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of equally long words: (places in the list, letter codes with the start mark)."""
    table = defaultdict(int, {ord(c): k + 2 for k, c in enumerate(letters)})
    by_length: dict[int, list[int]] = defaultdict(list)
    for k, word in enumerate(words):
        by_length[len(word)].append(k)
    # code points to letter codes by one table lookup
    top = max([ord(c) for c in letters], default=0) + 2
    lookup = np.zeros(top, dtype=np.int64)
    for point, code in table.items():
        lookup[point] = code
    for length, places in by_length.items():
        step = max(1, 400_000 // (length + 1))
        for at in range(0, len(places), step):
            some = places[at:at + step]
            points = np.frombuffer("".join(words[k] for k in some).encode("utf-32-le"),
                                   dtype=np.uint32).reshape(len(some), length)
            codes = np.ones((len(some), length + 1), dtype=np.int64)
            codes[:, 1:] = lookup[np.minimum(points, top - 1)]
            yield np.array(some), codes


def _rows(codes: np.ndarray, tables: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
          base: int) -> list[np.ndarray]:
    """Rows of the n-grams of each size; column j is the n-gram that ends before j + size."""
    out, node = [], np.zeros((len(codes), codes.shape[1] + 1), dtype=np.int64)
    for size, (keys, row_of, _) in enumerate(tables[:codes.shape[1]], 1):
        before = node[:, :-1]
        key = before * base + codes[:, size - 1:]
        at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        node = np.where((keys[at] == key) & ((before > 0) | (size == 1)), at + 1, 0)
        out.append(row_of[node])
    return out


class Scorer:
    """Forward sums of words, with a bounded store of words seen before."""

    def __init__(self, model: Model):
        self.model = model
        self.base = len(model.letters) + 2
        empty = np.zeros((1, len(model.languages)))
        self.tables = model.tables()
        self.probs = [np.vstack([empty, model.prob[own]]) for *_, own in self.tables]
        self.place: dict[str, int] = {}
        self.known = np.zeros((0, len(model.languages)))

    def forward(self, codes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Forward values after each position, scaled, and the log of the scale."""
        n, length = codes.shape
        rows = _rows(codes, self.tables, self.base)
        alpha = [np.ones((n, len(self.model.languages)))]
        scale = np.zeros((n, 1))
        for j in range(1, length + 1):
            sizes = range(1, min(j, len(rows)) + 1)
            total = sum(alpha[-size] * self.probs[size - 1][rows[size - 1][:, j - size]]
                        for size in sizes[:OFTEN])
            for size in sizes[OFTEN:]:
                row = rows[size - 1][:, j - size]
                held = np.flatnonzero(row)
                if len(held):
                    total[held] += alpha[-size][held] * self.probs[size - 1][row[held]]
            if j % 16 == 0 and length > 24:  # keep long words inside the range of doubles
                most = total.max(axis=1, keepdims=True)
                alpha = [a / most for a in alpha[-len(self.tables):]]
                total = total / most
                scale += np.log(most)
            alpha.append(total)
            if len(alpha) > len(self.tables) + 1:
                alpha.pop(0)
        return alpha, scale

    def score(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        for places, codes in _encoded(words, self.model.letters):
            alpha, scale = self.forward(codes)
            out[places] = np.log(alpha[-1]) + scale
        if self.model.seen is not None:
            out[[k for k, word in enumerate(words) if self.model.seen.isdisjoint(word)]] = 0
        return out

    def texts(self, texts: list[list[str]]) -> np.ndarray:
        """Log probability of each text, given as lists of words."""
        if len(self.place) > CACHE_WORDS:
            self.place, self.known = {}, self.known[:0]
        new = list(set().union(*texts) - self.place.keys())
        if new:
            self.place.update(zip(new, range(len(self.known), len(self.known) + len(new)),
                                  strict=True))
            self.known = np.vstack([self.known, self.score(new)])
        find = self.place.__getitem__
        return np.array([self.known[np.fromiter(map(find, t), dtype=np.int64, count=len(t))]
                         .sum(axis=0) for t in texts]).reshape(len(texts), -1)


def expected_counts(model: Model, words: list[str], weights: np.ndarray,
                    languages: np.ndarray) -> np.ndarray:
    """Expected piece counts (pieces, languages): forward and backward over each word.

    ``languages`` has each word's column; a word counts for its own language only.
    """
    base, tables = len(model.letters) + 2, model.tables()
    counts = np.zeros_like(model.prob)
    for places, codes in _encoded(words, model.letters):
        lang, weight = languages[places], weights[places]
        n, length = codes.shape
        prob, ids = [], []
        for (*_, own), row in zip(tables, _rows(codes, tables, base), strict=False):
            piece = np.append(own, 0)[row - 1]  # row 0 is no piece
            ids.append(piece)
            prob.append(np.where(row > 0, model.prob[piece, lang[:, None]], 0.0))
        alpha = np.zeros((n, length + 1))
        beta = np.zeros((n, length + 1))
        alpha[:, 0] = beta[:, length] = 1
        up, down = np.zeros(n), np.zeros(n)
        logs_a, logs_b = np.zeros((n, length + 1)), np.zeros((n, length + 1))
        for j in range(1, length + 1):
            sizes = range(1, min(j, len(prob)) + 1)
            alpha[:, j] = sum(alpha[:, j - s] * np.exp(logs_a[:, j - s] - up)
                              * prob[s - 1][:, j - s] for s in sizes)
            logs_a[:, j] = up = up + np.log(alpha[:, j])
            alpha[:, j] = 1
            i = length - j
            beta[:, i] = sum(prob[s - 1][:, i] * np.exp(logs_b[:, i + s] - down)
                             * beta[:, i + s] for s in sizes)
            logs_b[:, i] = down = down + np.log(beta[:, i])
            beta[:, i] = 1
        whole = logs_a[:, length]
        for s in range(1, len(prob) + 1):
            for i in range(length - s + 1):
                share = prob[s - 1][:, i] * np.exp(
                    logs_a[:, i] + logs_b[:, i + s] - whole) * weight
                np.add.at(counts, (ids[s - 1][:, i], lang), share)
    return counts


def _held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == HELD_OUT


def sampled(rows: DataFrame, sizes: dict[str, int], sample_docs: int) -> DataFrame:
    """About ``sample_docs`` rows of each ``lang``, of which there are ``sizes``, by a 63-bit hash."""
    bound = F.create_map(*[F.lit(x) for lang, n in sizes.items()
                           for x in (lang, min((sample_docs << 63) // n, (1 << 63) - 1))])
    return rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 1)
                      <= bound[F.col("lang")])


def training_words(docs: DataFrame, id_col: str, text_col: str, label_col: str,
                   sample_docs: int) -> DataFrame:
    """Rows (lang, word, n) of about ``sample_docs`` documents per label, held-out ones apart."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.col(label_col).cast("string").alias("lang")).where(
        ~_held_out("doc_id") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = dict(rows.groupBy("lang").count().collect())
    if not sizes:
        return rows.select("lang", F.lit("").alias("word"), F.lit(1).alias("n")).limit(0)
    some = sampled(rows, sizes, sample_docs)

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                seen.update((lang, w) for w in _WORD.findall(text.lower()))
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in seen.items()],
                               columns=["lang", "word", "n"])

    return (some.select("lang", "text").mapInPandas(words, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def sample_letters(words: DataFrame) -> set[str]:
    """Every letter of the words."""
    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[str] = set()
        for batch in batches:
            seen.update(*batch["word"])
        yield pd.DataFrame({"c": sorted(seen)}, dtype=object)

    return {r[0] for r in words.select("word").mapInPandas(letters, "c string")
            .distinct().collect()}


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "lang", vocabulary: str | None = None,
        sample_docs: int = SAMPLE_DOCS, rounds: int = ROUNDS) -> Model:
    """Piece probabilities per language; a model without languages if nothing is labelled."""
    words = written(training_words(docs, id_col, text_col, label_col, sample_docs), "lid-words")
    languages = sorted(r[0] for r in words.select("lang").distinct().collect())
    known = vocabulary_pieces(vocabulary)
    seen = frozenset(sample_letters(words))
    letters = "".join(sorted(seen.union(*known) - {START}))
    code = {START: 1} | {c: k + 2 for k, c in enumerate(letters)}
    pieces = {(k,) for k in range(len(letters) + 2)} | {tuple(code[c] for c in p) for p in known}
    pieces = sorted(pieces, key=lambda p: (len(p), p))
    model = Model(letters, pieces, languages, np.full((len(pieces), len(languages)),
                                                      1 / len(pieces)), seen)
    column = {lang: k for k, lang in enumerate(languages)}
    for _ in range(rounds if languages else 0):
        def count(batches: Iterator[pd.DataFrame], model: Model = model) -> Iterator[pd.DataFrame]:
            total = np.zeros_like(model.prob)
            for batch in batches:
                total += expected_counts(model, list(batch["word"]),
                                         batch["n"].to_numpy(dtype=float),
                                         batch["lang"].map(column).to_numpy())
            piece, lang = np.nonzero(total)
            yield pd.DataFrame({"piece": piece, "lang": lang, "n": total[piece, lang]})

        sums = (words.mapInPandas(count, "piece int, lang int, n double")
                .groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas())
        counts = np.full_like(model.prob, PRIOR)
        counts[sums["piece"], sums["lang"]] += sums["n"]
        model = Model(letters, pieces, languages, counts / counts.sum(axis=0), seen)
    return model


def predict(docs: DataFrame, model: Model, text_col: str, name: str) -> DataFrame:
    """``docs`` with a column ``name``: lang_pred and score of the row's text."""
    @F.pandas_udf("lang_pred string, score double")
    def classify(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for part in parts:
            texts = [t or "" for t in part]
            lang = np.full(len(texts), UNDETERMINED, dtype=object)
            score = np.zeros(len(texts))
            step = 500
            for at in range(0, len(texts), step):
                some = texts[at:at + step]
                has = np.array([bool(_PLAIN.search(t)) or any(map(str.isalpha, t)) for t in some])
                if not model.languages or not has.any():
                    continue
                logs = scorer.texts([_WORD.findall(t.lower()) for t in some])
                best = logs.argmax(axis=1)
                share = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
                lang[at:at + step] = np.where(has, np.array(model.languages, dtype=object)[best],
                                              UNDETERMINED)
                score[at:at + step] = np.where(has, share, 0.0)
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return docs.withColumn(name, classify(F.col(text_col)))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label_col: str = "lang", **options) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Learns from rows that are not held out and have a label; the label, the source and the
    id are no inputs of a prediction. Null texts and texts without a letter are ``und`` with
    score 0, as is everything when nothing is labelled; ties go to the first language by
    name. Score is the probability of the predicted language given the text, all languages
    being equally likely beforehand. An empty table gives no rows.
    """
    model = fit(docs, id_col, text_col, label_col, **options)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return predict(rows, model, "text", "found").select(
        "doc_id", _held_out("doc_id").alias("held_out"), "found.lang_pred", "found.score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose language is found with at least ``min_score``, with all their columns."""
    model = fit(docs, id_col, text_col, label_col)
    name = spare(docs, "_found")
    found = F.col(name)
    return predict(docs, model, text_col, name).where(
        (found["lang_pred"] != UNDETERMINED) & (found["score"] >= min_score)
        ).select(*docs.columns)


def op5_language_id(spark, sf_dir):
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
