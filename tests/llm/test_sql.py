import pytest

from clipfleet.llm import queries
from tests.compare import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, name, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""
