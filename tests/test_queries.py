"""Every query with SQL against that SQL, on the smallest tables; the entry point's contract."""

from __future__ import annotations

import ast
import pathlib

import __spark_entry__ as entry
import pytest
from oracle import compare

from tidemark.functions import text as T
from tidemark.plans import oracles, queries


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_matches_sql(spark, tiny, name):
    compare(spark, queries.queries()[name], oracles.oracle_sql()[name], tiny)


def test_every_query_has_sql():
    assert queries.queries().keys() == oracles.oracle_sql().keys()


def test_unique_ids_differ(spark):
    ids = [r[0] for r in spark.range(1000).select(T.unique_id()).collect()]
    assert len(set(ids)) == len(ids)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.queries()) <= set(entry.queries())


def test_nothing_else_imports_the_llm_subpackage():
    root = pathlib.Path(entry.__file__).parent
    for path in (root / "tidemark").rglob("*.py"):
        if "llm" in path.relative_to(root).parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("tidemark.llm") for n in names), path
