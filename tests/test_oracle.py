"""Every registered query against its SQL on the smallest tables."""

import pytest

from __spark_entry__ import REGISTRY, entry, oracle_sql, queries
from tests.oracle_compare import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, sf_dir, name):
    ok, _, note = compare(spark, con, REGISTRY[name], sf_dir)
    assert ok in (True, None), note


def test_contract(spark):
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).columns == ["document_type", "n_docs", "mean_confidence"]
