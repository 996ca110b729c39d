"""The registered queries against DuckDB, on the smallest tables."""

import os

import pytest

from treequill.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in catalog.ORDER:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{FOLDER}/{name}.parquet')")
    return con


def plain(df):
    df = df[sorted(df.columns)]
    return df.astype(str).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", [n for n in catalog.queries() if not n.startswith("fn_")] + ["fn_substring", "fn_round", "fn_tokenize", "fn_string_to_codepoints", "fn_duration_parts"])
def test_query(spark, duck, name):
    got, want = plain(catalog.queries()[name](spark, FOLDER).toPandas()), plain(duck.sql(catalog.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.equals(want)


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_library_imports_without_the_corpus_operators():
    import ast
    import pathlib

    root = pathlib.Path(catalog.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                assert not any("llm" in n.split(".") for n in names), path
