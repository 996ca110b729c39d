"""Functions over whole texts, against brute force: what differs stands behind any prefix."""

import duckdb
import pytest

from treequill.plans import catalog

TEXTS = ["", "a", "x" * 60 + "aeiou", "x" * 60 + "uoiea", "é😀" * 40 + "i", " " * 30 + "end\n", "é" * 50, None]
NUMBERS = ["7", " 42\n", "1.5", "1e3", "-INF", "+INF", "NaN", ".5", ".", "", "7 apples", "7" + " " * 80 + "x", "x7", "1" * 15, None]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(NUMBERS)], "conv_id long, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


def both(spark, folder, name, table):
    """The query's rows, and those of its SQL."""
    got = sorted(tuple(r) for r in catalog.queries()[name](spark, folder).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return got, sorted(con.sql(catalog.oracle_sql()[name]).fetchall())


def test_translate(spark, folder):
    got, sql = both(spark, folder, "fn_translate", "documents")
    table = str.maketrans("ae", "AE", "iou")
    assert got == sql == [(i, (t or "").translate(table)) for i, t in enumerate(TEXTS)]


def test_string_to_codepoints(spark, folder):
    got, sql = both(spark, folder, "fn_string_to_codepoints", "documents")
    assert got == sql == [(i, float(sum(map(ord, t or "")))) for i, t in enumerate(TEXTS)]


def test_castable(spark, folder):
    got, sql = both(spark, folder, "castable", "conversations")
    integers, doubles = {"7", " 42\n", "1" * 15}, {"7", " 42\n", "1" * 15, "1.5", "1e3", "-INF", "+INF", "NaN", ".5"}
    assert got == sql == [(i, 0, t in integers, t in doubles) for i, t in enumerate(NUMBERS)]
