"""The pipeline against its stages done by hand on a small table."""

from __future__ import annotations

import corpus_pipeline
from sparkrisk.llm import decontaminate, exact_dedup, language_id, simhash

from .tables import DOCS, words

ENGLISH = "the and of with that this from house water light have which".split()



def _rows():
    texts = [" ".join(f"{ENGLISH[(s * 7 + k * k) % 12]}{chr(97 + (s + k * s) % 26)}"
                      for k in range(70)) for s in range(12)]
    rows = [(k, t, "en", f"s{k % 4}", len(t)) for k, t in enumerate(texts)]
    rows += [(20 + k, t.replace(" ", "  "), "en", "s9", len(t)) for k, t in enumerate(texts[:4])]
    rows += [(30, texts[5] + " " + texts[6], "en", "s1", 0), (40, None, "en", "s1", 0),
             (41, "... 123", "en", "s1", 0), (42, "", None, None, None)]
    return texts, rows


def test_stages_take_effect_and_rows_are_packed(spark, tmp_path):
    texts, rows = _rows()
    folder = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(texts[7].split()[10:40])), (2, words(20, 5))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")

    model = language_id.fit(docs)
    found = language_id.predict(docs, model, "text", "found").collect()
    left = [r for r in found if r["found"]["lang_pred"] != "und" and r["found"]["score"] >= 0.5]
    assert {r["doc_id"] for r in found} - {r["doc_id"] for r in left} == {40, 41, 42}
    seen: dict = {}
    for r in sorted(left, key=lambda r: r["doc_id"]):
        seen.setdefault(" ".join((r["text"] or "").split()), r)
    left = list(seen.values())
    root: dict = {}
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in left}
    for k in sorted(prints):
        near = {root[j] for j in root if (prints[j] ^ prints[k]).bit_count() <= 2}
        root[k] = min(near | {k})
        root = {j: root[k] if v in near else v for j, v in root.items()}
    left = [r for r in left if root[r["doc_id"]] == r["doc_id"]]
    index = decontaminate.Index(items)
    hits = decontaminate._search_block([r["text"] for r in left], index)
    left = [r for r, h in zip(left, hits, strict=True) if not h]
    assert 7 not in {r["doc_id"] for r in left}

    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in left}
    assert {r["doc_id"]: r["n_words"] for r in got} == {
        r["doc_id"]: len(r["text"].split()) + 1 for r in left}


def test_stage_list():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_near_dedup", "decontamination", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert callable(exact_dedup.drop_copies)
