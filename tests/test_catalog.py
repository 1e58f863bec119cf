from __future__ import annotations

import pytest

from quillspan.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_sql(agree, name):
    agree(QUERIES[name], SQL[name])


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_core_imports_nothing_of_llm():
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "quillspan.llm" not in path.read_text(), path
