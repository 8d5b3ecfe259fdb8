import pytest

import __spark_entry__ as entry
from checks import compare, oracle, queries
from tests import dirty
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return compare.connect(SMALL)


def test_every_query_has_sql():
    assert set(queries.registered()) == set(oracle.statements())
    assert set(queries.registered()) <= set(entry.queries())
    assert set(oracle.statements()) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query_equals_sql(spark, connection, name):
    assert compare.differences(spark, connection, SMALL, name) == []


@pytest.fixture(scope="module")
def spoiled(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("dirty"))
    dirty.write(SMALL, root)
    return root, compare.connect(root)


@pytest.mark.parametrize("name", sorted(queries.registered()))
def test_query_equals_sql_on_dirty_tables(spark, spoiled, name):
    root, connection = spoiled
    assert compare.differences(spark, connection, root, name) == []


@pytest.fixture(scope="module")
def bare(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("empty"))
    dirty.write_empty(SMALL, root)
    return root, compare.connect(root)


@pytest.mark.parametrize(
    "name",
    [n for n in sorted(queries.registered()) if n.startswith(("profile_", "dq_", "src_", "dash_"))],
)
def test_query_equals_sql_on_empty_tables(spark, bare, name):
    """Every rule and column is reported, with 0 where there is nothing to count."""
    root, connection = bare
    assert compare.differences(spark, connection, root, name) == []


def test_entry(spark):
    assert entry.entry(spark).count() > 0
