"""Every registered query against its reference SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from concordat.plans.catalogue import QUERIES
from check_reference import compare, duck

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_reference_sql(spark, con, name):
    outcome = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name])
    assert outcome.startswith("ok"), outcome


def test_flagship_query(spark):
    frame = entry.entry(spark)
    assert frame.columns == ["kind", "a_fact_id", "b_fact_id", "sign", "direction"] and not frame.isEmpty()
