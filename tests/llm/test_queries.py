"""Registered corpus queries against plain SQL on the smallest tables."""

import pytest

from __spark_entry__ import oracle_sql, queries
from sparkrisk.llm.registry import CORPUS_ORACLE, CORPUS_QUERIES
from tools.check import compare, connect

SMALL = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in CORPUS_QUERIES} == {f"op{k}" for k in range(1, 14)} | {"pipeline"}
    assert set(CORPUS_QUERIES) <= set(queries()) and set(CORPUS_ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(CORPUS_ORACLE))
def test_query_equals_sql(spark, name):
    assert compare(CORPUS_QUERIES[name](spark, SMALL), connect(SMALL), CORPUS_ORACLE[name]) is None
