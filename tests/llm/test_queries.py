import pytest

from orrery.llm.queries import oracle_sql, queries
from tests.conftest import SF
from tests.oracle import check


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, name):
    sql = oracle_sql()
    if name in sql:
        check(spark, SF, queries()[name], sql[name])
    else:
        queries()[name](spark, SF).count()
