import oracle
import pytest

from tracklore.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_sql(spark, name):
    oracle.check(spark, oracle.connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF)
