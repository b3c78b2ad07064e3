"""Every query with SQL gives the rows of its SQL; the rest run."""

import importlib
import sys

import pytest

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
from tessera.plans.queries import QUERIES, SQL  # noqa: E402
from tests.compare import connect, spark_rows, sql_rows  # noqa: E402


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_as_sql(spark, sf, con, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_entry():
    e = importlib.import_module("__spark_entry__")
    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_the_subpackage():
    import glob
    import re

    root = __file__.rsplit("/tests/", 1)[0]
    for path in glob.glob(f"{root}/tessera/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert not re.search(r"^\s*(from|import) tessera\.llm", open(path).read(), re.M), path
