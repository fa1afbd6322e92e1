"""Every registered query against plain SQL, on the given tables and on a skewed copy."""

import random

import pytest

from __spark_entry__ import entry
from sparkrisk.operators import models
from sparkrisk.oracle import ORACLE
from sparkrisk.queries import QUERIES
from sparkrisk.queries import model_run, raw
from sparkrisk.sources.star import encounters_raw
from tools.check import TABLES, canonical, compare, connect

SMALL = "/root/testdata/sf0.001"
MODEL_QUERIES = {"model_comparison", "model_performance", "fairness_check", "feature_importance",
                 "scored_fact", "model_worklist", "band_validation", "lift_vs_rule",
                 "shap_global", "shap_reliable", "shap_local"}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_only_model_queries_lack_sql():
    assert set(QUERIES) - set(ORACLE) == MODEL_QUERIES
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    assert compare(QUERIES[name](spark, SMALL), duck, ORACLE[name]) is None


def test_entry(spark):
    rows = entry(spark).collect()
    assert [r["utilization_tier"][0] for r in rows] == ["0", "1", "3", "6"][:len(rows)]


def test_stage_table_is_written_once(spark):
    assert raw(spark, SMALL).inputFiles() == raw(spark, SMALL + "/").inputFiles()


def test_stage_table_holds_facts_only(spark):
    """The fifty columns of the raw table are derived on reading, not stored."""
    rows = raw(spark, SMALL)
    stored = spark.read.parquet(*rows.inputFiles())
    assert len(rows.columns) == 50 and len(stored.columns) < 20
    assert rows.exceptAll(encounters_raw(spark, SMALL)).isEmpty()
    assert rows.count() == encounters_raw(spark, SMALL).count()


def test_tree_attribution_is_computed_once(spark):
    """Smallest id and explanation read one table."""
    plan = QUERIES["fixed_tree_local"](spark, SMALL)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    """Orders of which a third belong to one customer, several on the same day."""
    folder, rnd = tmp_path_factory.mktemp("skewed"), random.Random(11)
    orders = [(k, 7 if rnd.random() < 0.34 else rnd.randrange(60), rnd.randrange(900),
               rnd.choice(["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]))
              for k in range(2000)]
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, d int, o_orderpriority string")
    frame.selectExpr("o_orderkey", "o_custkey", "o_orderpriority",
                     "CAST(date_add(DATE'1996-01-01', d) AS TIMESTAMP_NTZ) AS o_orderdate"
                     ).write.parquet(f"{folder}/orders.parquet")
    items = [(rnd.randrange(2000), float(rnd.randrange(1, 50)), rnd.choice("RAN"))
             for _ in range(6000)]
    spark.createDataFrame(items, "l_orderkey long, l_quantity double, l_returnflag string"
                          ).write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(c, c % 25) for c in range(60)], "c_custkey long, c_nationkey int"
                          ).write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_history_of_a_hot_customer(spark, skewed):
    import duckdb

    from sparkrisk.oracle import RAW

    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed}/{t}.parquet/*.parquet')")
    cur = con.execute(f"WITH {RAW} SELECT * FROM raw")
    want = canonical([d[0] for d in cur.description], cur.fetchall())
    df = encounters_raw(spark, skewed)
    assert canonical(df.columns, [tuple(r) for r in df.collect()]) == want


@pytest.mark.parametrize("name", ["clean_full", "ntile_deciles", "risk_bands", "roc_curve",
                                  "group_split_exact", "iqr_outliers", "segment_matrix"])
def test_queries_on_skewed_tables(spark, skewed, name):
    import duckdb

    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed}/{t}.parquet/*.parquet')")
    assert compare(QUERIES[name](spark, skewed), con, ORACLE[name]) is None


def test_models_are_fitted_on_all_training_rows(spark, tmp_path, monkeypatch):
    """20,000 orders: scalers, categories, class weights, thresholds and models see every one."""
    spark.range(20_000).selectExpr(
        "id AS o_orderkey", "id % 4000 AS o_custkey", "'1-URGENT' AS o_orderpriority",
        "CAST(date_add(DATE'1996-01-01', CAST(id * 7 % 800 AS int)) AS TIMESTAMP_NTZ) AS o_orderdate"
    ).write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(20_000).selectExpr(
        "id AS l_orderkey", "CAST(id % 50 AS double) AS l_quantity", "'R' AS l_returnflag"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(4000).selectExpr("id AS c_custkey", "CAST(id % 25 AS int) AS c_nationkey"
                                 ).write.parquet(f"{tmp_path}/customer.parquet")
    encoded, settings = [], []

    def watched(train, *rest, encode=models.encode_training):
        encoder, rows = encode(train, *rest)
        encoded.append((train.count(), rows.count()))
        return encoder, rows

    def tree_only(n_rows, *rest, configs=models.model_configs):
        settings.append(n_rows)
        return {"Decision Tree": configs(n_rows, *rest)["Decision Tree"]}

    monkeypatch.setattr(models, "encode_training", watched)
    monkeypatch.setattr(models, "model_configs", tree_only)
    n = model_run(spark, str(tmp_path)).table.filter("data_split = 'train'").count()
    assert n > 12_000 and encoded == [(n, n), (n, n)] and settings == [n]


def test_tables_are_the_given_ones():
    assert len(TABLES) == 14
