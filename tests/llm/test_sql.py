import pytest

from goldseam.llm import queries, sql
from tests.llm.tables import differences

DIRECTORIES = ("/root/testdata/sf0.001", "/root/testdata/sf0.01")


@pytest.mark.parametrize("sf_dir", DIRECTORIES)
@pytest.mark.parametrize("name", sql.statements())
def test_query_equals_its_sql(spark, name, sf_dir):
    df = queries.registered()[name](spark, sf_dir)
    assert differences(df, sql.statements()[name], sf_dir) == []
