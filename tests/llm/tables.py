"""Small tables for the corpus operators, with the cases every operator must bear."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use themselves
EXTRA = ["rid", "run", "fp", "key", "word", "score", "kept", "hits", "spans", "n", "label",
         "_hits", "_found", "_id", "_sha", "_kept", "group", "shard", "lang_pred", "digest"]


def words(n: int, seed: int, of: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(of)}x" for _ in range(n))


def documents(spark, texts: list, first_id: int = 1):
    """One document per text."""
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts, first_id)]
    return spark.createDataFrame(rows, DOCS)


def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, odd characters."""
    same = words(60, 1)
    rows = [
        (1, same, "en", "a", 1), (2, same, "en", "a", 1), (2, same, "en", "a", 1),
        (2, words(30, 2), None, None, None), (3, None, "en", "a", 0), (4, "", "en", "b", 0),
        (5, "   \t\n ", "en", None, 3), (None, same, "fr", "a", 1), (None, None, None, None, None),
        (6, words(30_000, 3), "fr", "a", 9), (7, "x" * 50_000, "fr", "b", 9),
        (8, "naïve Ünïcödé 𝒳 日本語 \u0000 \x7f … " * 20, "fr", "c", 9),
        (9, same + " tail", "en", "a", 1), (10, "one", "en", "a", 1), (-4, "!!! ??? 123", "de", "a", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def with_extra(df):
    """The same rows with further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    return df.select("*", *[F.lit("extra").alias(c) for c in EXTRA if c not in df.columns])


def empty(df):
    return df.limit(0)


def rows_of(df, *columns):
    """Rows as sorted tuples."""
    chosen = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in chosen.collect()), key=repr)
