"""The driver's contract."""

import __spark_entry__ as entry


def test_queries_and_oracles(spark):
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert set(entry.catalog.QUERIES) <= set(oracles)
    assert entry.entry(spark).count() == 3287


def test_nothing_else_imports_the_text_operators():
    import pathlib

    root = pathlib.Path(entry.__file__).parent / "lattica"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "lattica.llm" not in path.read_text(), path
