import oracle
import pytest

from sweetframe.llm.queries import ORACLE_SQL, QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(D)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, con, name):
    oracle.check(spark, con, QUERIES[name], ORACLE_SQL[name], D)
