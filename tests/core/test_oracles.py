import pytest

from corvane import queries
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    assert_same(spark, sf_dir, queries.queries()[name], queries.oracle_sql()[name])


def test_every_query_without_sql_gives_rows(spark, sf_dir):
    """That they are the right ones is tested by brute force: test_search.py, test_vector_index.py, test_pages_whole.py."""
    for name in queries.queries().keys() - queries.oracle_sql().keys():
        assert queries.queries()[name](spark, sf_dir).count() > 0, name


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
