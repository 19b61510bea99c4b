"""Every query against its SQL twin, on the smallest tables."""

import pytest
from oracle import compare, connect

import __spark_entry__ as driver


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_sql(spark, con, small, name):
    assert compare(spark, con, small, driver.queries()[name], driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_query_without_sql_gives_rows(spark, small, name):
    assert driver.queries()[name](spark, small).count() > 0


def test_entry_gives_one_row_per_job(spark):
    rows = driver.entry(spark).collect()
    assert rows and len({r.job_id for r in rows}) == len(rows)
