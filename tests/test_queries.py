"""Every query of the library proper against its SQL on the smallest tables."""

import pytest

from sedimenta.queries import FLAGSHIP, ORACLE_SQL, QUERIES
from tests.oracle import SMALL, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SMALL)) == sql_rows(ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES and FLAGSHIP in ORACLE_SQL
