"""License scans: an exact set-similarity join between text blocks and license templates.

A block is a line. A block matches a template when it holds at least ``threshold`` of the
template's distinct words. Words are ordered by how many documents of the whole corpus hold
them, rarest first; with overlap o = ceil(threshold * t) needed of t template words,

* prefix filter: a match shares one of the first t - o + 1 template words, and one of the
  first b - o + 1 of the block's b words;
* length filter: a match needs b >= o;
* positional filter: with the first shared word at i of the template and j of the block, the
  overlap is at most 1 + min(t - i - 1, b - j - 1);

and what passes is verified by counting. Only words of templates take part in the order:
a block is cut down to them, which changes no overlap. Beside the join, ``phrases`` are
found as words that stand consecutively anywhere in the document.

Everything is DataFrame functions. The templates are the bounded side: their number is
checked before they are sent to all tasks.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkrisk.llm.common import ascii_lower, text_of
from sparkrisk.workspace import written

WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
THRESHOLD = 0.8
MAX_TEMPLATES = 10_000

# fixed values: phrases and their labels
PHRASES = [("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl")]
# fixed values: opening words of well-known license notices
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification"
            " are permitted provided that the following conditions are met"),
    ("cc", "this work is licensed under a creative commons attribution international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the"
            " terms of the gnu general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of"
            " this software and associated documentation files"),
    ("mit", "this project is released under the mit license"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
]
# end of fixed values


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _starts(words: str, phrase: list[str]) -> str:
    """SQL: word positions, from 0, where the phrase begins."""
    same = " AND ".join(f"get({words}, i + {k}) = '{w}'" if k else f"w = '{w}'"
                        for k, w in enumerate(phrase))
    return f"filter(transform({words}, (w, i) -> CASE WHEN {same} THEN i END), i -> i IS NOT NULL)"


def document_frequencies(docs: DataFrame, text_col: str, vocabulary: list[str]) -> dict[str, int]:
    """In how many documents each word of a bounded vocabulary stands."""
    held = F.array_intersect(_words(ascii_lower(text_of(text_col))),
                             F.array(*[F.lit(w) for w in vocabulary]))
    rows = docs.select(F.explode(held).alias("word")).groupBy("word").count()
    return {word: n for word, n in rows.collect()}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 phrases: list[tuple[str, str]] = PHRASES,
                 templates: list[tuple[str, str]] = TEMPLATES,
                 threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row.

    doc_id, n_words, n_base (places of all phrases), first_word and last_word (smallest and
    largest start of a phrase, words from 0, null without one), base_labels, labels (with the
    templates' ones), score (largest containment of a matching template, else 0), n_blocks
    (matching blocks). Null texts count as empty: no words, no labels, score 0. Repeated rows
    and ids are scanned each on their own. An empty table gives no rows.
    """
    if len(templates) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    spark = docs.sparkSession
    sets = [(n, label, sorted(set(text.split()))) for n, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, words in sets for w in words})
    seen = document_frequencies(docs, text_col, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    rank = {w: k for k, w in enumerate(order)}
    ordered = [(n, label, sorted(rank[w] for w in words), ceil(threshold * len(words) - 1e-9))
               for n, label, words in sets]
    least = min((need for *_, need in ordered), default=1)
    rare = sorted({order[r] for _, _, ranks, need in ordered
                   for r in ranks[:len(ranks) - need + 1]})
    ranks_of = F.create_map(*[F.lit(x) for w in order for x in (w, rank[w])])

    lists = [[w for w in phrase.split()] for phrase, _ in phrases]
    gate = F.arrays_overlap("_words", F.array(*[F.lit(w) for w in {w for x in lists for w in x}]))
    lower = ascii_lower(text_of(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), lower.alias("_lower")).withColumn(
        "_words", _words(F.col("_lower")))
    # lines that hold a word of some template's prefix, cut down to ranks in global order
    cut = F.transform(
        F.split("_lower", "\n"),
        lambda line: F.array_sort(F.transform(
            F.array_intersect(_words(line), F.array(*[F.lit(w) for w in order])),
            lambda w: ranks_of[w])))
    narrow = base.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        *[F.when(gate, F.expr(_starts("_words", x))).alias(f"_at{k}")
          for k, x in enumerate(lists)],
        F.when(F.arrays_overlap("_words", F.array(*[F.lit(w) for w in rare])),
               F.filter(cut, lambda b: F.size(b) >= least)).alias("blocks"))
    narrow = written(narrow, "license-words")

    index = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"),
                 F.lit(len(ranks)).alias("t"), F.lit(need).alias("need"),
                 F.lit(i).alias("i"), F.lit(r).alias("rank"),
                 F.array(*[F.lit(x) for x in ranks]).alias("ranks"))
        for n, label, ranks, need in ordered
        for i, r in enumerate(ranks[:len(ranks) - need + 1])])))
    blocks = narrow.where(F.size("blocks") > 0).select(
        "rid", F.posexplode("blocks").alias("block", "own"))
    prefix = blocks.select("rid", "block", "own", F.posexplode(
        F.slice("own", F.lit(1), F.size("own") - least + 1)).alias("j", "rank"))
    first = (prefix.join(F.broadcast(index), "rank")
             .where(F.size("own") >= F.col("need"))
             .groupBy("rid", "block", "template").agg(
                 F.min(F.struct("i", "j")).alias("at"),
                 F.first("own").alias("own"), F.first("ranks").alias("ranks"),
                 F.first("t").alias("t"), F.first("need").alias("need"),
                 F.first("label").alias("label"))
             .where(F.col("need") <= 1 + F.least(F.col("t") - F.col("at.i") - 1,
                                                 F.size("own") - F.col("at.j") - 1)))
    both = F.size(F.array_intersect("own", "ranks"))
    found = (first.where(both >= F.col("need")).groupBy("rid").agg(
        F.collect_set("label").alias("more"), F.max(both / F.col("t")).alias("best"),
        F.countDistinct("block").alias("hits")))

    places = F.concat(*[F.coalesce(f"_at{k}", F.array().cast("array<int>"))
                        for k in range(len(lists))])
    named = F.array_sort(F.array_distinct(F.filter(
        F.array(*[F.when(F.size(f"_at{k}") > 0, F.lit(label))
                  for k, (_, label) in enumerate(phrases)]), lambda x: x.isNotNull())))
    every = F.array_sort(F.array_union(named, F.coalesce("more", F.array().cast("array<string>"))))
    return narrow.join(found, "rid", "left").select(
        "doc_id", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        F.array_join(named, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
        F.coalesce("best", F.lit(0.0)).alias("score"),
        F.coalesce("hits", F.lit(0)).cast("long").alias("n_blocks"))


def op6_license_scan(spark, sf_dir):
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    places = " UNION ALL ".join(
        "SELECT doc_id, unnest(list_filter(range(len(words)), lambda i: "
        + " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))
        + f")) AS spot, '{label}' AS label FROM d" for phrase, label in PHRASES)
    kinds = " UNION ALL ".join(
        f"SELECT '{label}' AS label, {sorted(set(text.split()))!r} AS want"
        for label, text in TEMPLATES)
    return rf"""
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS body FROM documents),
d AS (SELECT doc_id, body,
             regexp_extract_all(body, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM t),
places AS ({places}),
base AS (
  SELECT doc_id, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
         list(DISTINCT label) AS found FROM places GROUP BY doc_id),
templates AS ({kinds}),
lines AS (
  SELECT doc_id, block, regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own
  FROM (SELECT doc_id, unnest(string_split(body, chr(10))) AS line,
               unnest(range(len(string_split(body, chr(10))))) AS block FROM t)),
hits AS (
  SELECT doc_id, block, label, len(list_intersect(want, own))::DOUBLE / len(want) AS share
  FROM lines, templates
  WHERE len(list_intersect(want, own)) >= ceil({THRESHOLD} * len(want) - 1e-9)),
method AS (
  SELECT doc_id, list(DISTINCT label) AS found, max(share) AS score,
         count(DISTINCT block) AS n_blocks FROM hits GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word,
       last_word, array_to_string(list_sort(coalesce(base.found, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(
         coalesce(base.found, []), coalesce(method.found, [])))), ',') AS labels,
       coalesce(score, 0.0)::DOUBLE AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN method USING (doc_id)
"""


OP6_SQL = _sql()
