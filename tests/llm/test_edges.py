"""Every operator and every stage on awkward rows, clashing columns and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sparkrisk.llm import (
    decontaminate,
    exact_dedup,
    html_text,
    language_id,
    license_scan,
    merkle_manifest,
    minhash,
    packing,
    periodic_runs,
    secret_scan,
    simhash,
    suffix_dedup,
    warc,
)

from .tables import awkward, empty, rows_of, with_extra


def _items(spark):
    return spark.createDataFrame(
        [(1, "alpha beta gamma delta epsilon zeta"), (2, None), (None, "a b c d e f"), (3, "")],
        "item_id long, text string")


def _pages(df):
    return df.select(F.col("doc_id").alias("page_id"), F.col("source").alias("url"),
                     F.col("text").alias("html"))


OPERATORS = {
    "pack": lambda s, d: packing.pack(d),
    "simhash": lambda s, d: simhash.near_dedup(d),
    "suffix": lambda s, d: suffix_dedup.suffix_dedup(d, first_stays=False),
    "suffix_first": lambda s, d: suffix_dedup.suffix_dedup(d, with_text=True),
    "decontaminate": lambda s, d: decontaminate.decontamination(d, _items(s)),
    "language": lambda s, d: language_id.language_id(d),
    "license": lambda s, d: license_scan.license_scan(d),
    "warc": lambda s, d: warc.warc_round_trip(_pages(d)),
    "html": lambda s, d: html_text.extract_text(_pages(d)),
    "exact": lambda s, d: exact_dedup.exact_dedup(d),
    "secrets": lambda s, d: secret_scan.secret_scan(d),
    "minhash": lambda s, d: minhash.near_dedup(d),
    "runs": lambda s, d: periodic_runs.periodic_runs(d, plant=True),
    "manifest": lambda s, d: merkle_manifest.manifest(d, slab=1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    docs = awkward(spark)
    found = OPERATORS[name](spark, docs)
    key = "page_id" if "page_id" in found.columns else "doc_id"
    ids = found.where("piece = 0") if "piece" in found.columns else found
    assert rows_of(ids, key) == rows_of(docs, "doc_id")
    extra = OPERATORS[name](spark, with_extra(docs))
    assert extra.columns == found.columns
    skip = {"rid", "bin_id", "offset"}
    same = [c for c in found.columns if c not in skip]
    if name != "pack":
        assert rows_of(extra, *same) == rows_of(found, *same)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, empty(awkward(spark))).count() == 0


@pytest.mark.parametrize("place", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, place, tmp_path):
    docs = awkward(spark)
    _items(spark).write.parquet(str(tmp_path / "benchmark.parquet"))
    name, stage = corpus_pipeline.STAGES[place]
    last = place == len(corpus_pipeline.STAGES) - 1
    out = stage(spark, with_extra(docs), str(tmp_path))
    if not last:
        assert out.columns == with_extra(docs).columns
        assert set(rows_of(out, *docs.columns)) <= set(rows_of(docs))
    assert out.count() > 0
    assert stage(spark, empty(docs), str(tmp_path)).count() == 0
