import compare
import pytest

from kawara.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    assert compare.difference(spark, compare.duck(SF), queries.queries()[name], queries.oracle_sql()[name], SF) == ""
