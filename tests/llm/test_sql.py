import pytest
from comparing import differences, oracle_connection

from opsloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), oracle_connection(SF), queries.oracle_sql()[name]) is None
