"""Validation throughput: about 15 MB of XML in documents of some kilobytes, schema compiled and documents read beforehand."""

from __future__ import annotations

import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treequill.sources import shred
from treequill.xsd import onepass
from treequill.xsd.schema import compile_schema
from treequill.xsd.validate import validate

SCHEMA = """
<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="items"><xs:complexType><xs:sequence><xs:element name="item" type="Item" maxOccurs="unbounded"/></xs:sequence></xs:complexType></xs:element>
  <xs:complexType name="Item">
    <xs:sequence><xs:element name="name" type="xs:string"/><xs:element name="price" type="Price"/><xs:element name="day" type="xs:date" minOccurs="0"/><xs:element name="note" type="xs:token" minOccurs="0" maxOccurs="3"/></xs:sequence>
    <xs:attribute name="id" type="xs:ID" use="required"/><xs:attribute name="kind" type="Kind"/>
  </xs:complexType>
  <xs:simpleType name="Price"><xs:restriction base="xs:decimal"><xs:minInclusive value="0"/><xs:fractionDigits value="2"/></xs:restriction></xs:simpleType>
  <xs:simpleType name="Kind"><xs:restriction base="xs:token"><xs:enumeration value="new"/><xs:enumeration value="used"/></xs:restriction></xs:simpleType>
</xs:schema>
"""


def documents(spark: SparkSession, count: int = 2000, items: int = 50):
    """Documents of ``items`` items, about 150 bytes each; one price in a thousand is negative."""
    item = F.transform(
        F.sequence(F.lit(1), F.lit(items)),
        lambda i: F.concat(
            F.lit('<item id="i'), i.cast("string"), F.lit('" kind="new"><name>Name of item '), i.cast("string"), F.lit("</name><price>"), F.when((F.col("id") * items + i) % 1000 == 0, F.lit("-1")).otherwise((i * 1.25).cast("decimal(8, 2)").cast("string")),
            F.lit("</price><day>2024-02-29</day><note>some words of a note</note></item>"),
        ),
    )
    return spark.range(count).select(F.col("id").alias("doc_id"), F.concat(F.lit("<items>"), F.array_join(item, ""), F.lit("</items>")).alias("xml"))


def run(spark: SparkSession) -> dict:
    docs = documents(spark).cache()
    size = docs.agg(F.sum(F.octet_length("xml"))).first()[0] / 1e6
    schema = compile_schema(SCHEMA)
    docs = docs.repartition(spark.sparkContext.defaultParallelism).cache()
    docs.count()
    onepass.violations(docs, schema).count()
    began = time.perf_counter()
    found = onepass.violations(docs, schema).count()
    seconds = time.perf_counter() - began
    began = time.perf_counter()
    nodes = shred.shred(docs).persist()
    joined = validate(spark, nodes, schema).violations.count()
    by_joins = time.perf_counter() - began
    nodes.unpersist()
    docs.unpersist()
    return {"seconds": round(seconds, 3), "mb": round(size, 2), "mb_per_s": round(size / seconds, 2), "violations": found, "node_table_seconds": round(by_joins, 3), "node_table_violations": joined}
