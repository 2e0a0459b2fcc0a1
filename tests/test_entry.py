"""The driver's contract, and that the library does without its operators for text."""

from __future__ import annotations

import ast
import importlib
import pathlib
import sys

import __spark_entry__ as entry
import pytest

ROOT = pathlib.Path(__file__).parent.parent


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "flagship" in sql and len(queries) >= 50


def test_without_text_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("granary.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "granary.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(entry)
    assert "flagship" in bare.queries() and not [q for q in bare.queries() if q.startswith("op") or q == "pipeline"]
    monkeypatch.undo()
    importlib.reload(entry)


def test_nothing_else_imports_them():
    for path in (ROOT / "granary").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            named = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or "", *(a.name for a in node.names)] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or "corpus_pipeline" in n for n in named), path


@pytest.mark.parametrize("name", ["flagship", "dnf_tuples", "nan_negated", "categorical_order", "rows_repeated", "append_truncate_append", "sorted_rows_permutation", "bitmap_isin", "index_refresh", "list_null_empty"])
def test_against_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    if not pathlib.Path(sf).is_dir():
        pytest.skip("no test tables")
    df = entry.queries()[name](spark, sf)
    con = duckdb.connect()
    for t in ("lineitem", "orders", "customer", "events", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    columns = sorted(d[0] for d in want.description)
    order = [[d[0] for d in want.description].index(c) for c in columns]
    assert sorted(df.columns) == columns
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", ["arrow_round_trip", "selection_to_arrow", "large_lists"])
def test_arrow_stays_with_executors(spark, name, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(self):
        raise AssertionError("a whole table goes to the driver")

    with monkeypatch.context() as m:
        for how in ("toArrow", "toPandas"):
            m.setattr(DataFrame, how, refused)
        test_against_sql(spark, name)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
