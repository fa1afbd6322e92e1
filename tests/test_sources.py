"""Readers, sinks, catalog and script runner."""

import pytest
from pyspark.sql import functions as F

from sparkrisk import spec as S
from sparkrisk.sources import catalog, readers, sinks
from sparkrisk.sources.lookups import LOOKUPS, lookup, lookups


@pytest.fixture(scope="module")
def codebook(tmp_path_factory):
    """The three code tables stacked in one file, separated by a comma line."""
    parts = []
    for name, rows in LOOKUPS.items():
        lines = [f"{name}_id,description"]
        lines += [f'{k},"{v}"' if "," in v else f"{k},{v}" for k, v in rows.items()]
        parts.append("\n".join(lines))
    path = tmp_path_factory.mktemp("codebook") / "codes.csv"
    path.write_text("\n,\n".join(parts) + "\n")
    return str(path)


def test_codebook_sections(spark, codebook):
    tables = readers.split_codebook(spark, codebook)
    assert {n: t.count() for n, t in tables.items()} == {
        "admission_type": 8, "discharge_disposition": 30, "admission_source": 25}
    for name, table in tables.items():
        got = {r[0]: r[1] for r in table.collect()}
        assert got == LOOKUPS[name]
        assert table.columns == [f"{name}_id", "description"]


def test_lookup_round_trip_keeps_text(spark, tmp_path):
    sinks.export_dims(lookups(spark), str(tmp_path))
    back = readers.read_lookup(spark, str(tmp_path / "dim_admission_source"), "admission_source_id")
    assert {r[0]: r[1] for r in back.collect()} == LOOKUPS["admission_source"]
    types = readers.read_lookup(spark, str(tmp_path / "dim_admission_type"), "admission_type_id")
    assert types.filter(F.col("description") == "NULL").count() == 1
    assert types.filter(F.col("description").isNull()).count() == 0


def test_read_encounters_by_header_and_declared_types(spark, tmp_path):
    from sparkrisk.sources.star import encounters_raw

    raw = encounters_raw(spark, "/root/testdata/sf0.001").limit(50)
    shuffled = raw.select(*[f"`{c}`" for c in reversed(raw.columns)])
    sinks.write_csv(shuffled, str(tmp_path / "raw"), single_file=True)
    back = readers.read_encounters(spark, str(tmp_path / "raw"))
    assert back.columns == raw.columns and back.schema == S.RAW_SCHEMA
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, shuffled.select(
        *[f"`{c}`" for c in raw.columns]).collect()))
    with pytest.raises(ValueError):
        readers.read_encounters(spark, str(tmp_path / "raw"), S.CLEAN_SCHEMA)


def test_summary_document(spark, tmp_path):
    row = ("Tree", 0.5, 0.1, 0.2, 0.3, 0.6, 20.0, 21.0, 1.5)
    doc = spark.createDataFrame([([row], "Tree", (0.6, 0.61, 0.01))], readers.SUMMARY_SCHEMA)
    sinks.write_summary(doc, str(tmp_path / "summary"))
    back = readers.read_summary(spark, str(tmp_path / "summary"))
    assert back.collect() == doc.collect()
    from sparkrisk.operators import serve
    table = serve.model_performance_table(
        doc.select(F.inline("model_comparison")), back).first()
    assert (table["model"], table["top_decile_lift"]) == ("Tree", 1.5)
    assert [r["roc_auc"] for r in serve.fairness_table(back).collect()] == [0.6, 0.61]


def test_scripts_run_in_order_and_survive_errors(spark, tmp_path):
    catalog.register(spark, {"visits": spark.createDataFrame(
        [(0, "a", 1), (2, "b", 0), (9, "b", 1), (1, "a", 0)], "u int, change string, y int")})
    (tmp_path / "b.sql").write_text("""-- comment; with a semicolon
SELECT CASE WHEN u = 0 THEN 'none' WHEN u BETWEEN 1 AND 2 THEN 'few' ELSE 'many' END AS tier,
       COUNT(*) AS n FROM visits GROUP BY tier ORDER BY MIN(u);
SELECT nothing FROM visits;
  -- another; one
SELECT change, ROUND(100.0 * SUM(y) / COUNT(*), 2) AS pct FROM visits GROUP BY change
ORDER BY change""")
    (tmp_path / "a.sql").write_text(
        "SELECT CASE change WHEN 'a' THEN 'A' END AS t FROM visits GROUP BY change ORDER BY change;")
    got = list(catalog.run_sql_dir(spark, str(tmp_path), out=str(tmp_path / "out")))
    assert [(r.file, r.number, r.error is None) for r in got] == [
        ("a.sql", 1, True), ("b.sql", 1, True), ("b.sql", 2, False), ("b.sql", 3, True)]
    assert [r["tier"] for r in got[1].df.collect()] == ["none", "few", "many"]
    assert [float(r["pct"]) for r in got[3].df.collect()] == [50.0, 50.0]


def test_execution_errors_are_recorded(spark, tmp_path):
    catalog.register(spark, {"t": spark.range(3)})
    (tmp_path / "x.sql").write_text("SELECT 1 / (id - 1) AS v FROM t; SELECT max(id) AS m FROM t")
    got = list(catalog.run_sql_dir(spark, str(tmp_path), out=str(tmp_path / "out")))
    assert got[0].error and got[1].df.first()["m"] == 2


def test_register_replaces(spark):
    catalog.register(spark, {"again": spark.range(2)})
    catalog.register(spark, {"again": spark.range(5)})
    assert spark.table("again").count() == 5


def test_lookup_gaps(spark):
    assert 16 not in {r[0] for r in lookup(spark, "admission_source").collect()}


def test_fact_export_is_partitioned_by_split(spark, tmp_path):
    df = spark.createDataFrame([(1, "test"), (2, "train")], "encounter_id long, data_split string")
    sinks.export_fact(df, str(tmp_path / "fact"), csv=True)
    back = spark.read.parquet(str(tmp_path / "fact"))
    plan = back.filter("data_split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_split" in plan
    assert spark.read.csv(str(tmp_path / "fact_csv"), header=True).count() == 2


def test_a_failed_export_leaves_the_old_version(spark, tmp_path):
    path = str(tmp_path / "fact")
    with pytest.raises(FileNotFoundError):
        readers.read_export(spark, path)
    old = spark.range(5).selectExpr("id", "'test' AS data_split")
    sinks.publish_fact(old, path)
    assert readers.read_export(spark, path).count() == 5
    broken = spark.range(9).selectExpr(
        "if(id = 8, cast(raise_error('no') AS bigint), id) AS id", "'test' AS data_split")
    with pytest.raises(Exception, match="no"):
        sinks.publish_fact(broken, path)
    assert readers.read_export(spark, path).count() == 5
    reader = readers.read_export(spark, path)
    sinks.publish_fact(spark.range(7).selectExpr("id", "'train' AS data_split"), path, csv=True)
    assert reader.count() == 5  # a reader at work keeps what it began with
    assert readers.read_export(spark, path).count() == 7
    assert len(sinks.versions(spark, path)) == 2


def test_codebook_in_many_splits(spark, tmp_path):
    """A codebook of several thousand lines, read in small splits."""
    path = tmp_path / "book.csv"
    lines = ["admission_type_id,description"] + [f'{k},"text, {k}"' for k in range(4000)]
    lines += [",", "admission_source_id,description"] + [f"{k}, word {k}" for k in range(3000)]
    path.write_text("\r\n".join(lines) + "\r\n")
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
        found = readers.split_codebook(spark, str(path))
        assert {k: v.count() for k, v in found.items()} == {"admission_type": 4000,
                                                            "admission_source": 3000}
        types = found["admission_type"].collect()
        assert {r["admission_type_id"]: r["description"] for r in types} == {
            k: f"text, {k}" for k in range(4000)}
        assert found["admission_source"].filter("admission_source_id = 7").first()[1] == " word 7"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
