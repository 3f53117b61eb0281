import pytest

from oracle import check, connect
from tagloom.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def db():
    return connect()


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_its_sql(spark, db, name):
    check(spark, QUERIES[name], ORACLE[name], db)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLE])
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").columns
