"""Every query against its SQL twin on the smallest tables; the others must return rows."""

import pytest

from checks import ORACLES, QUERIES
from checks.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, sf, name):
    assert compare(spark, con, name, sf) is None


def test_twins_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark)
    assert {"dataset_name", "policy", "n_llm", "accuracy", "avg_cents", "avg_error"} <= set(rows.columns)
    assert rows.count() == 25
