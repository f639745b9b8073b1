import pytest

from corvane.llm import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])
