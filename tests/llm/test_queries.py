"""The registered queries over the shared tables."""

import pytest
from conftest import SF

from __spark_entry__ import oracle_sql, queries
from skillbridge.llm.queries import ORACLES, QUERIES
from tools.check import canonical


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].partition("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(ORACLES) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = db.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


@pytest.mark.parametrize("name", ["op1_importance_resampling", "op2_byte_bpe", "op7_language_id", "op10_toxicity"])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
