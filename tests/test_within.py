"""Paths that are walked where a document is read: what node tables find, and plans without exchanges."""

import pytest
from pyspark.sql import functions as F
from test_documents import BOOKS, MIXED, NODES, VALUES

from treequill.operators import identity
from treequill.plans import catalog, documents, within
from treequill.plans.compiler import Static
from treequill.plans.engine import Engine
from treequill.sources import shred
from treequill.xsd.schema import compile_schema
from treequill.xsd.validate import Options, Validator, validate

DEEP = "<r xmlns:q='urn:q'><a k='1'><a k='2'>x<b q:k='3'/></a><!--c-->y</a><b/><?p d?><a><b><a/></b></a>z</r>"
AXES = ("child", "descendant", "self", "descendant-or-self", "following-sibling", "following", "parent", "ancestor", "preceding-sibling", "preceding", "ancestor-or-self", "attribute", "namespace")


@pytest.fixture(scope="module")
def engines(spark):
    rows = [(1, BOOKS), (2, MIXED), (3, "<a><b></a>"), (4, None), (5, "<!DOCTYPE a [<!ENTITY e 'x'>]><a>&e;</a>"), (6, "<p:a/>"), (7, DEEP)]
    docs = spark.createDataFrame(rows, "doc_id long, xml string")
    names = {"x": "urn:books"}
    return Engine(spark, namespaces=names).documents(docs), Engine(spark, namespaces=names).nodes(shred.shred(docs).cache())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("axis", AXES)
def test_axes_find_what_node_tables_find(engines, axis):
    found = []
    for e in engines:
        rows = [e.query(f"{start}/{axis}::{test}").collect() for start, test in (("//a", "node()"), ("//@k", "node()"), ("//b", "*"), ("/r/a/a", "node()[last()]"))]
        found.append([sorted((r.doc, r.pre) for r in x) for x in rows])
    assert found[0] == found[1]


@pytest.mark.parametrize("text", [n[0] for n in NODES])
def test_paths_find_what_node_tables_find(engines, text):
    found = [[(r["doc"], r["pre"]) for r in e.query(text, ordered=True).collect()] for e in engines]
    assert found[0] == found[1]


@pytest.mark.parametrize("text", [v[0] for v in VALUES if "//book[1]" not in v[0] and "base-uri" not in v[0]])
def test_values_are_those_of_node_tables(engines, text):
    found = [sorted(str(r["item"]) for r in e.query(text).collect()) for e in engines]
    assert found[0] == found[1]


@pytest.mark.parametrize("name", ["axes", "node_return"])
def test_registered_queries_exchange_no_documents(spark, tmp_path, name):
    rows = [(1, "A", 3, "X"), (2, "B & b", None, None), (3, "C", 4, "Y")]
    spark.createDataFrame(rows, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").write.parquet(str(tmp_path / "customer.parquet"))
    df = catalog.queries()[name](spark, str(tmp_path))
    assert "Join" not in physical(df) and "hashpartitioning" not in physical(df)
    if name == "axes":
        assert {r.axis: r.n for r in df.collect()} == {"child": 2, "descendant": 2, "self": 2, "descendant-or-self": 4, "following-sibling": 2, "following": 4, "parent": 2, "ancestor": 4, "preceding-sibling": 4, "preceding": 8, "ancestor-or-self": 6}
    else:
        assert sorted(r.v for r in df.collect()) == ["A|X|4", "B & b||2", "C|Y|4"]


def test_constraints_read_a_document_in_one_pass(spark):
    rows = [(1, "<r><i k='1' to='1'/><j k='2'/></r>"), (2, "<r><i k='1'/><j k='01'/></r>"), (3, "<r><i to='3'/></r>"), (4, "<r/>"), (5, "<r><i></r>")]
    nodes = shred.shred(spark.createDataFrame(rows, "doc_id long, xml string")).withColumn("types", F.when(F.col("kind") == "attribute", F.array(F.lit("int"), F.lit("decimal"))))
    nodes.createOrReplaceTempView("tq_within_test")
    static = Static(nodes="tq_within_test", typed=True)
    constraints = [identity.Constraint("key", "k", "//r", "i | j", ("@k",)), identity.Constraint("keyref", "ref", "//r", ".//i", ("@to",), "k")]
    read = identity.tuples(spark, static, constraints)
    assert all("Join" not in physical(df) and "Exchange" not in physical(df) for df in read)
    assert sorted((r.doc, r.f0 or "") for r in read[0].collect()) == [(1, "1"), (1, "2"), (2, "1"), (2, "1"), (3, "")]
    found = sorted((r.doc, r.code) for r in identity.violations(spark, static, constraints).collect())
    assert found == [(2, identity.DUPLICATE), (3, identity.INCOMPLETE), (3, identity.MISSING)]


def test_assertions_read_a_document_in_one_pass(spark, monkeypatch):
    schema = compile_schema(documents.XS.format(documents.VALIDATION["xsd_assert"][0]))
    # As numbers 9 < 10, as texts not; a document's nodes lie in several batches.
    high = {1: [10], 2: [8], 3: [1, 10], 4: [10, 11, 8], 5: [7, 7, 10]}
    rows = [(d, "<r><low>9</low>" + "".join(f"<high>{h}</high>" for h in hs) + "</r>") for d, hs in high.items()]
    plans, rules = [], Validator.assertion_rules
    monkeypatch.setattr(Validator, "assertion_rules", lambda self, *a: [plans.append(physical(df)) or df for df in rules(self, *a)])
    monkeypatch.setattr(within, "ROWS", 1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        found = validate(spark, shred.shred(spark.createDataFrame(rows, "doc_id long, xml string")).cache(), schema, Options(assertions=True)).violations
        assert sorted((r.doc, r.path, r.message) for r in found.collect()) == [(2, "/r", "low < high[last()]"), (3, "/r", "count(high) != 2"), (4, "/r", "low < high[last()]")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(plans) == 2 and not any("Join" in p or "Exchange" in p for p in plans)
