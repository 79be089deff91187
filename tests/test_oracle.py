"""Every core query beside its SQL, on the smallest tables."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

CASES = [(name, f, m.ORACLE.get(name)) for m in map(importlib.import_module, entry._CORE) for name, f in m.QUERIES.items()]


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize(("name", "query", "sql"), CASES, ids=[c[0] for c in CASES])
def test_query(spark, small, con, name, query, sql):
    said = compare(spark, con, name, query, sql, small)
    assert " equal," in said or "no SQL" in said, said


def test_the_comparison_sees_differences(spark, small, con):
    query = dict((n, f) for n, f, _ in CASES)["knowledge_stats"]
    assert "DIFFERS" in compare(spark, con, "x", query, "SELECT 1 AS sources, 2 AS items, 3 AS chars", small)
    assert "COLUMNS DIFFER" in compare(spark, con, "x", query, "SELECT 1 AS a", small)


def test_entry(spark):
    assert entry.entry(spark).columns == ["tbl", "snapshot_no", "source_id", "item_key", "change_type"]


def test_the_core_does_not_import_the_llm_package():
    import pathlib
    import re

    root = pathlib.Path(__file__).parent.parent / "quern"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import) quern\.llm", path.read_text(), re.M), path
