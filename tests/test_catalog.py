import pytest
from compare import assert_same

from terraloom.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_is_imported_without_a_session():
    import subprocess
    import sys

    here = __file__.rsplit("/", 2)[0]
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=here, capture_output=True, text=True, timeout=120)
    assert found.returncode == 0 and int(found.stdout) > 100, found.stderr
