import pytest
from compare import difference

from tremolo.plans import all_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(all_queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert difference(all_queries.QUERIES[name](spark, SF), all_queries.ORACLES[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(all_queries.QUERIES) - set(all_queries.ORACLES)))
def test_query_has_rows(spark, name):
    assert len(all_queries.QUERIES[name](spark, SF).take(5)) > 0
