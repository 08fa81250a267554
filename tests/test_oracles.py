"""Every registered query that has SQL gives the same rows as the SQL."""

import pytest
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from skillbridge.plans.oracles import ORACLES
from skillbridge.plans.registry import QUERIES
from tools.check import canonical

NO_SQL = {"embed_hash", "knn_ivf", "knn_lsh", "surrogate_ids", "recommend_text", "stream_recommend_text"}


def test_which_queries_have_sql():
    assert set(QUERIES) - set(ORACLES) == NO_SQL
    assert set(ORACLES) <= set(QUERIES)
    assert set(oracle_sql()) <= set(queries()) and set(QUERIES) <= set(queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    got = queries()[name](spark, SF).toPandas()
    want = db.execute(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry(spark).count() > 0
