"""Registered queries over documents that are built from table rows: schema validation, node functions, sinks.

An entry builds a document of each row of ``part`` whose faults follow from the
row's numbers, so its SQL names the faulty rows, paths and codes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.plans import lineage
from treequill.plans.engine import Engine
from treequill.sources import shred
from treequill.xpath.errors import XPathError
from treequill.xsd import onepass
from treequill.xsd.schema import compile_schema
from treequill.xsd.validate import Options, typed_nodes, validate

XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns:vc="http://www.w3.org/2007/XMLSchema-versioning">{}</xs:schema>'
XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'
ROOT = '<xs:element name="r"><xs:complexType>{}</xs:complexType></xs:element>'


def _when(*cases: tuple[str, str], other: str = "") -> str:
    """SQL of the text of the first case that holds."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{text}'" for test, text in cases) + f" ELSE '{other}' END"


def _of(*parts: str) -> str:
    """SQL of a document r around parts, each SQL of its own."""
    return "concat('<r>', " + ", ".join(parts) + ", '</r>')"


#: name -> (schema, SQL of a row's document, [(SQL of the faulty rows, path, code)], checks that only the node table's validator makes)
VALIDATION: dict[str, tuple[str, str, list[tuple[str, str, str]], Options | None]] = {
    "xsd_choice": (ROOT.format('<xs:choice><xs:element name="a" type="xs:int"/><xs:element name="b" type="xs:date"/></xs:choice>'),
        _of(_when(("p_size % 2 = 0", "<a>1</a>"), other="<b>2020-02-29</b>"), _when(("p_size % 5 = 0", "<a>2</a>"))), [("p_size % 5 = 0", "/r", "cvc-complex-type.2.4")], None),
    "xsd_all": (ROOT.format('<xs:all><xs:element name="a"/><xs:element name="b" minOccurs="0"/><xs:element name="c"/></xs:all>'),
        _of(_when(("p_size % 7 = 0", "<a/><b/>"), ("p_size % 11 = 0", "<c/><a/><a/>"), ("p_size % 2 = 0", "<c/><a/>"), other="<b/><c/><a/>")), [("p_size % 7 = 0 OR p_size % 11 = 0", "/r", "cvc-complex-type.2.4")], None),
    "xsd_occurs": (f'<xs:group name="g"><xs:sequence><xs:element name="e"/></xs:sequence></xs:group>{ROOT.format("""<xs:sequence><xs:group ref="g" minOccurs="2" maxOccurs="4"/><xs:element name="f" minOccurs="0"/></xs:sequence>""")}',
        _of("repeat('<e/>', CAST(p_size % 7 AS INT))", _when(("p_size % 3 = 0", "<f/>"))), [("p_size % 7 NOT BETWEEN 2 AND 4", "/r", "cvc-complex-type.2.4")], None),
    "xsd_substitution": ('<xs:element name="h" type="xs:integer" abstract="true"/><xs:element name="m" type="xs:int" substitutionGroup="h"/><xs:element name="n" type="xs:positiveInteger" substitutionGroup="h"/>' + ROOT.format('<xs:sequence><xs:element ref="h"/></xs:sequence>'),
        _of("CASE p_size % 4 WHEN 0 THEN '<m>5</m>' WHEN 1 THEN '<n>0</n>' WHEN 2 THEN '<n>7</n>' ELSE '<h>3</h>' END"),
        [("p_size % 4 = 1", "/r/n", "cvc-datatype-valid"), ("p_size % 4 = 3", "/r", "cvc-complex-type.2.4"), ("p_size % 4 = 3", "/r/h", "cvc-elt.2")], None),
    "xsd_wildcard": ('<xs:element name="g" type="xs:int"/>' + ROOT.format('<xs:sequence><xs:any processContents="lax"/><xs:any namespace="urn:x" processContents="skip" minOccurs="0"/></xs:sequence><xs:anyAttribute namespace="urn:x" processContents="skip"/>'),
        _of("CASE p_size % 4 WHEN 0 THEN '<g>1</g>' WHEN 1 THEN '<g>one</g>' WHEN 2 THEN '<free><g>1</g></free>' ELSE '<free/>' END", _when(("p_size % 3 = 0", '<x:any xmlns:x="urn:x"><g>skipped</g></x:any>'), ("p_size % 3 = 1", '<y:any xmlns:y="urn:y"/>'))),
        [("p_size % 4 = 1", "/r/g", "cvc-datatype-valid"), ("p_size % 3 = 1", "/r", "cvc-complex-type.2.4")], None),
    "xsd_attributes": (ROOT.format('<xs:sequence/><xs:attribute name="need" type="xs:int" use="required"/><xs:attribute name="fix" type="xs:decimal" fixed="1.0"/><xs:attribute name="no" type="xs:int" use="prohibited"/><xs:anyAttribute namespace="##other" processContents="skip"/>'),
        "concat('<r', " + _when(("p_size % 2 = 0", ' need="1"'), ("p_size % 3 = 0", ' need="x"')) + ", " + _when(("p_size % 5 = 0", ' fix="2"'), ("p_size % 5 = 1", ' fix="1.00"'), ("p_size % 5 = 2", ' fix="1.0"')) + ", " + _when(("p_size % 7 = 0", ' no="1"'), ("p_size % 7 = 1", ' xmlns:o="urn:o" o:free="1"'), ("p_size % 7 = 2", ' own="1"')) + ", '/>')",
        [("p_size % 2 <> 0 AND p_size % 3 <> 0", "/r", "cvc-complex-type.4"), ("p_size % 2 <> 0 AND p_size % 3 = 0", "/r/@need", "cvc-datatype-valid"), ("p_size % 5 = 0", "/r/@fix", "cvc-attribute.4"), ("p_size % 7 = 0", "/r/@no", "cvc-complex-type.3.2.2"), ("p_size % 7 = 2", "/r/@own", "cvc-complex-type.3.2.2")], None),
    "xsd_xsi_type": ('<xs:complexType name="B" abstract="true"><xs:sequence><xs:element name="v" type="xs:int"/></xs:sequence></xs:complexType><xs:complexType name="D"><xs:complexContent><xs:extension base="B"><xs:sequence><xs:element name="w" type="xs:int"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType><xs:complexType name="Z"><xs:sequence><xs:element name="v"/></xs:sequence></xs:complexType>' + ROOT.format('<xs:sequence><xs:element name="e" type="B"/></xs:sequence>'),
        _of(f"CASE p_size % 4 WHEN 0 THEN '<e {XSI} xsi:type=\"D\"><v>1</v><w>2</w></e>' WHEN 1 THEN '<e><v>1</v></e>' WHEN 2 THEN '<e {XSI} xsi:type=\"Z\"><v>1</v></e>' ELSE '<e {XSI} xsi:type=\"D\"><v>1</v></e>' END"),
        [("p_size % 4 IN (1, 2)", "/r/e", "cvc-type.2"), ("p_size % 4 = 2", "/r/e", "cvc-elt.4.3"), ("p_size % 4 = 3", "/r/e", "cvc-complex-type.2.4")], None),
    "xsd_nil": (ROOT.format('<xs:sequence><xs:element name="a" type="xs:int" nillable="true"/><xs:element name="b" type="xs:int" minOccurs="0"/></xs:sequence>'),
        _of(f"CASE p_size % 3 WHEN 0 THEN '<a {XSI} xsi:nil=\"true\"/>' WHEN 1 THEN '<a {XSI} xsi:nil=\"true\">1</a>' ELSE '<a/>' END", _when(("p_size % 5 = 0", f'<b {XSI} xsi:nil="true">1</b>'))),
        [("p_size % 3 = 1", "/r/a", "cvc-elt.3.2.1"), ("p_size % 3 = 2", "/r/a", "cvc-datatype-valid"), ("p_size % 5 = 0", "/r/b", "cvc-elt.3.1")], None),
    "xsd_id_idref": (ROOT.format('<xs:sequence><xs:element name="e" maxOccurs="unbounded"><xs:complexType><xs:attribute name="id" type="xs:ID"/><xs:attribute name="to" type="xs:IDREFS"/></xs:complexType></xs:element></xs:sequence>'),
        "concat('<r><e id=\"i', p_size, '\"/><e id=\"j\" to=\"j i', p_size % 10, '\"/>', " + _when(("p_size % 4 = 0", '<e id="j"/>')) + ", '</r>')", [("p_size >= 10", "", "cvc-id.1"), ("p_size % 4 = 0", "", "cvc-id.2")], None),
    "xsd_list_union": ('<xs:simpleType name="L"><xs:restriction><xs:simpleType><xs:list itemType="xs:int"/></xs:simpleType><xs:maxLength value="3"/></xs:restriction></xs:simpleType><xs:simpleType name="U"><xs:union memberTypes="xs:date L"/></xs:simpleType>' + ROOT.format('<xs:sequence><xs:element name="l" type="L"/><xs:element name="u" type="U"/></xs:sequence>'),
        "concat('<r><l>', repeat(' 7', CAST(p_size % 6 AS INT)), " + _when(("p_size % 9 = 0", " x")) + ", '</l><u>', " + _when(("p_size % 4 = 0", "2021-02-30"), ("p_size % 4 = 1", "2021-02-28"), ("p_size % 4 = 2", "1 2")) + ", '</u></r>')",
        [("p_size % 9 = 0", "/r/l", "cvc-datatype-valid"), ("p_size % 9 <> 0 AND p_size % 6 > 3", "/r/l", "cvc-maxLength-valid"), ("p_size % 4 = 0", "/r/u", "cvc-datatype-valid")], None),
    "xsd_text": ('<xs:complexType name="M" mixed="true"><xs:sequence><xs:element name="e"><xs:complexType/></xs:element></xs:sequence></xs:complexType>' + ROOT.format('<xs:sequence><xs:element name="m" type="M"/></xs:sequence>'),
        _of(_when(("p_size % 3 = 0", "text"), other=" "), _when(("p_size % 2 = 0", "<m>mixed <e/> text</m>"), other="<m><e> </e></m>")), [("p_size % 3 = 0", "/r", "cvc-complex-type.2.3"), ("p_size % 2 <> 0", "/r/m/e", "cvc-complex-type.2.1")], None),
    "xsd_fixed": (ROOT.format('<xs:sequence><xs:element name="f" type="xs:decimal" fixed="2.50"/><xs:element name="d" type="xs:int" default="4"/></xs:sequence>'),
        _of("concat('<f>', CASE p_size % 3 WHEN 0 THEN '2.5' WHEN 1 THEN '' ELSE '2.51' END, '</f><d>', CASE p_size % 2 WHEN 0 THEN '' ELSE 'z' END, '</d>')"), [("p_size % 3 = 2", "/r/f", "cvc-elt.5.2.2.2"), ("p_size % 2 <> 0", "/r/d", "cvc-datatype-valid")], None),
    "xsd_white_space": ('<xs:simpleType name="P"><xs:restriction base="xs:string"><xs:length value="3"/></xs:restriction></xs:simpleType><xs:simpleType name="C"><xs:restriction base="xs:token"><xs:length value="3"/></xs:restriction></xs:simpleType>' + ROOT.format('<xs:choice><xs:element name="p" type="P"/><xs:element name="c" type="C"/></xs:choice>'),
        _of(_when(("p_size % 2 = 0", "<p> a&#10;</p>"), ("p_size % 3 = 0", "<c>  a  b </c>"), ("p_size % 5 = 0", "<c> a </c>"), other="<p> a b </p>")), [("p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_size % 5 = 0", "/r/c", "cvc-length-valid"), ("p_size % 2 <> 0 AND p_size % 3 <> 0 AND p_size % 5 <> 0", "/r/p", "cvc-length-valid")], None),
    "xsd_timezone_facet": ('<xs:simpleType name="Z"><xs:restriction base="xs:date"><xs:explicitTimezone value="required"/></xs:restriction></xs:simpleType><xs:element name="r" type="Z"/>',
        "concat('<r>2020-01-01', CASE p_size % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+05:00' ELSE '' END, '</r>')", [("p_size % 3 = 2", "/r", "cvc-explicitTimezone-valid")], None),
    "xsd_open_content": (ROOT.format('<xs:openContent mode="suffix"><xs:any namespace="##other" processContents="skip"/></xs:openContent><xs:sequence><xs:element name="k"/></xs:sequence>'),
        _of(_when(("p_size % 2 = 0", '<k/><x:a xmlns:x="urn:x"/>'), ("p_size % 3 = 0", '<x:a xmlns:x="urn:x"/><k/>'), other="<k/>")), [("p_size % 2 <> 0 AND p_size % 3 = 0", "/r", "cvc-complex-type.2.4")], None),
    "xsd_conditional_inclusion": ('<xs:simpleType name="T" vc:minVersion="1.1"><xs:restriction base="xs:int"/></xs:simpleType><xs:simpleType name="T" vc:maxVersion="1.1"><xs:restriction base="xs:string"/></xs:simpleType><xs:element name="r" type="T"/>',
        "concat('<r>', p_size, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END, '</r>')", [("p_size % 3 = 0", "/r", "cvc-datatype-valid")], None),
    "xsd_alternative": (ROOT.replace('name="r"', 'name="r" type="E"').replace("<xs:complexType>{}</xs:complexType>", '<xs:alternative test="@kind = \'n\'" type="N"/><xs:alternative test="@kind &gt; 5" type="X"/>') + '<xs:complexType name="E" mixed="true"><xs:sequence><xs:any processContents="lax" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:anyAttribute processContents="lax"/></xs:complexType><xs:complexType name="N"><xs:complexContent><xs:restriction base="E"><xs:sequence><xs:element name="n" type="xs:int"/></xs:sequence><xs:attribute name="kind"/></xs:restriction></xs:complexContent></xs:complexType><xs:complexType name="X"><xs:complexContent><xs:restriction base="E"><xs:sequence/><xs:attribute name="kind"/></xs:restriction></xs:complexContent></xs:complexType>',
        "concat('<r kind=\"', CASE WHEN p_size % 2 = 0 THEN 'n' ELSE CAST(p_size % 9 AS VARCHAR(9)) END, '\"><n>', CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '1' END, '</n></r>')",
        [("p_size % 2 = 0 AND p_size % 3 = 0", "/r/n", "cvc-datatype-valid"), ("p_size % 2 <> 0 AND p_size % 9 > 5", "/r", "cvc-complex-type.2.1")], Options()),
    "xsd_assert": (ROOT.format('<xs:sequence><xs:element name="low" type="xs:int"/><xs:element name="high" type="xs:int" maxOccurs="3"/></xs:sequence><xs:assert test="low &lt; high[last()]"/><xs:assert test="count(high) != 2"/>'),
        "concat('<r><low>', p_size, '</low>', repeat('<high>30</high>', CAST(1 + p_size % 3 AS INT)), '</r>')", [("p_size >= 30", "/r", "cvc-assertion"), ("p_size % 3 = 1", "/r", "cvc-assertion")], Options(assertions=True)),
    "xsd_assertion_facet": ('<xs:simpleType name="Odd"><xs:restriction base="xs:int"><xs:assertion test="$value mod 2 = 1"/><xs:maxInclusive value="40"/></xs:restriction></xs:simpleType><xs:element name="r" type="Odd"/>',
        "concat('<r>', p_size, '</r>')", [("p_size % 2 = 0", "/r", "cvc-assertion"), ("p_size % 2 <> 0 AND p_size > 40", "/r", "cvc-maxInclusive-valid")], Options()),
    "xsd_identity": (ROOT.format('<xs:sequence><xs:element name="i" maxOccurs="unbounded"><xs:complexType><xs:attribute name="k" type="xs:int"/><xs:attribute name="to" type="xs:int"/></xs:complexType></xs:element></xs:sequence>').replace("</xs:element>", "</xs:element>").removesuffix("</xs:element>")
        + '<xs:key name="k"><xs:selector xpath="i"/><xs:field xpath="@k"/></xs:key><xs:keyref name="ref" refer="k"><xs:selector xpath="./i"/><xs:field xpath="@to"/></xs:keyref><xs:unique name="u"><xs:selector xpath=".//i"/><xs:field xpath="@to"/></xs:unique></xs:element>',
        "concat('<r><i k=\"1\" to=\"', p_size % 4, '\"/><i', CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN ' k=\"01\"' ELSE ' k=\"2\"' END, '/><i k=\"3\"', CASE WHEN p_size % 7 = 0 THEN ' to=\"1\"' ELSE '' END, '/></r>')",
        [("p_size % 4 = 0 OR p_size % 4 = 2 AND p_size % 5 IN (0, 1)", "//r", "cvc-identity-constraint.4.3"), ("p_size % 5 = 0", "//r", "cvc-identity-constraint.4.2.1"), ("p_size % 5 = 1", "//r", "cvc-identity-constraint.4.2.2"), ("p_size % 7 = 0 AND p_size % 4 = 1", "//r", "cvc-identity-constraint.4.1")], Options(identity=True)),
}

FILES = {
    "size.xsd": XS.format('<xs:simpleType name="Size"><xs:restriction base="xs:int"/></xs:simpleType><xs:element name="size" type="Size"/>'),
    "other.xsd": XS.format('<xs:attribute name="mark" type="xs:int"/><xs:element name="o" type="xs:boolean"/>').replace("<xs:schema ", '<xs:schema targetNamespace="urn:o" '),
}
SIZED = "concat('<size>', p_size, CASE WHEN p_size % 3 = 0 THEN 'x' ELSE '' END, '</size>')"
#: The same over schemas that are composed of several documents.
COMPOSED = {
    "xsd_include_import": ('<xs:include schemaLocation="size.xsd"/><xs:import namespace="urn:o" schemaLocation="other.xsd"/><xs:element name="r"><xs:complexType><xs:sequence><xs:element ref="size"/><xs:element xmlns:o="urn:o" ref="o:o" minOccurs="0"/></xs:sequence><xs:attribute xmlns:o="urn:o" ref="o:mark"/></xs:complexType></xs:element>',
        f"concat('<r xmlns:o=\"urn:o\" o:mark=\"', CASE WHEN p_size % 2 = 0 THEN '1' ELSE 'z' END, '\">', {SIZED}, CASE WHEN p_size % 5 = 0 THEN '<o:o>maybe</o:o>' ELSE '' END, '</r>')", [("p_size % 2 <> 0", "/r/@mark", "cvc-datatype-valid"), ("p_size % 3 = 0", "/r/size", "cvc-datatype-valid"), ("p_size % 5 = 0", "/r/o", "cvc-datatype-valid")], None),
    "xsd_redefine": ('<xs:redefine schemaLocation="size.xsd"><xs:simpleType name="Size"><xs:restriction base="Size"><xs:maxInclusive value="25"/></xs:restriction></xs:simpleType></xs:redefine>', SIZED, [("p_size % 3 = 0", "/size", "cvc-datatype-valid"), ("p_size % 3 <> 0 AND p_size > 25", "/size", "cvc-maxInclusive-valid")], None),
    "xsd_override": ('<xs:override schemaLocation="size.xsd"><xs:simpleType name="Size"><xs:restriction base="xs:string"><xs:pattern value="[0-4]+x?"/></xs:restriction></xs:simpleType></xs:override>', SIZED, [("NOT regexp_matches(p_size || '', '^[0-4]+$')", "/size", "cvc-pattern-valid")], None),
}


def _parts(spark: SparkSession, folder: str, xml: str) -> DataFrame:
    rows = lineage.spread(spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_brand", "p_size"))
    return rows.select(F.col("p_partkey").alias("doc_id"), F.expr(xml).alias("xml"))


def _validated(schema: str, xml: str, options: Options | None, loader: dict | None = None):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        compiled, docs = compile_schema(XS.format(schema), loader=loader), _parts(spark, folder, xml)
        found = onepass.violations(docs, compiled) if options is None else validate(spark, lineage.cut(shred.shred(docs)), compiled, options).violations
        return found.select("doc", "path", "code")

    return run


def _faults(cases: list[tuple[str, str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT p_partkey AS doc, '{path}' AS path, '{code}' AS code FROM part WHERE {test}" for test, path, code in cases)


# Schemas that don't hold together: (name, body, code), each found by the compiler.
BAD = [
    ("resolve", '<xs:element name="a" type="Nope"/>', "src-resolve"), ("duplicate", '<xs:element name="a"/><xs:element name="a"/>', "sch-props-correct"), ("two values", '<xs:element name="a" default="1" fixed="2"/>', "src-element"),
    ("cycle", '<xs:complexType name="A"><xs:complexContent><xs:extension base="B"/></xs:complexContent></xs:complexType><xs:complexType name="B"><xs:complexContent><xs:extension base="A"/></xs:complexContent></xs:complexType>', "ct-props-correct.3"),
    ("ambiguous", '<xs:complexType name="A"><xs:sequence><xs:element name="a" minOccurs="0"/><xs:element name="a"/></xs:sequence></xs:complexType>', "cos-nonambig"),
    ("inconsistent", '<xs:complexType name="A"><xs:choice><xs:element name="a" type="xs:int"/><xs:sequence><xs:element name="b"/><xs:element name="a" type="xs:date"/></xs:sequence></xs:choice></xs:complexType>', "cos-element-consistent"),
    ("occurs", '<xs:complexType name="A"><xs:sequence minOccurs="2" maxOccurs="1"/></xs:complexType>', "p-props-correct"), ("facet", '<xs:simpleType name="S"><xs:restriction base="xs:string"><xs:totalDigits value="2"/></xs:restriction></xs:simpleType>', "cos-applicable-facets"),
    ("loose", '<xs:simpleType name="S"><xs:restriction base="xs:byte"><xs:minInclusive value="5"/><xs:maxInclusive value="4"/></xs:restriction></xs:simpleType>', "st-props-correct"), ("final", '<xs:complexType name="F" final="extension"/><xs:complexType name="G"><xs:complexContent><xs:extension base="F"/></xs:complexContent></xs:complexType>', "cos-ct-extends"),
    ("restriction", '<xs:complexType name="B"><xs:sequence><xs:element name="a" type="xs:int"/></xs:sequence></xs:complexType><xs:complexType name="R"><xs:complexContent><xs:restriction base="B"><xs:sequence><xs:element name="z" type="xs:int"/></xs:sequence></xs:restriction></xs:complexContent></xs:complexType>', "derivation-ok-restriction"),
    ("attributes", '<xs:complexType name="A"><xs:attribute name="a" type="xs:int"/><xs:attribute name="a" type="xs:int"/></xs:complexType>', "ct-props-correct"), ("substitution", '<xs:element name="h" type="xs:int"/><xs:element name="m" type="xs:string" substitutionGroup="h"/>', "e-props-correct.4"), ("sound", '<xs:element name="a" type="xs:int"/>', "none"),
]


def _schema_checks(spark: SparkSession, folder: str) -> DataFrame:
    rows = []
    for name, body, _ in BAD:
        try:
            compile_schema(XS.format(body))
            rows.append((name, "none"))
        except XPathError as e:
            rows.append((name, e.code))
    return spark.createDataFrame(rows, "name string, code string")


# Documents with names, namespaces and all kinds of nodes.

DOC = (
    "concat('<r', CASE WHEN p_size % 2 = 0 THEN ' xmlns:q=\"urn:q\"' ELSE '' END, ' xmlns:p=\"urn:p', p_size % 3, '\" key=\"', p_partkey, '\" xml:lang=\"', CASE WHEN p_size % 2 = 0 THEN 'de-AT' ELSE 'en' END, '\" xml:base=\"http://h/', p_size, '/\">',"
    " '<!--note ', p_size, '--><p:a k=\"', p_size, '\" xml:id=\"i', p_size % 5, '\">some &amp;lt; ', p_brand, '</p:a>', CASE WHEN p_size % 7 = 0 THEN '<b/>' ELSE '' END, '<?pi data ', p_size, '?><b " + XSI + " xsi:nil=\"', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END, '\"></b></r>')"
)
#: name -> (expression over all documents, DuckDB SQL of its values, of a row of part each)
NODE_VALUES = {
    "node_lang": ("for $r in /r return lang('de', $r)", "p_size % 2 = 0"),
    "node_base_uri": ("for $r in /r return string(base-uri($r))", "'http://h/' || p_size || '/'"),
    "node_root": ("for $r in /r return string(root($r))", "'some &lt; ' || p_brand"),
    "node_prefixes": ("for $r in /r return count(in-scope-prefixes($r))", "CASE WHEN p_size % 2 = 0 THEN 3 ELSE 2 END::BIGINT"),
    "node_prefix_uri": ("for $r in /r return string(namespace-uri-for-prefix('p', $r))", "'urn:p' || p_size % 3"),
    "node_resolve_QName": ("for $r in /r return string(namespace-uri-from-QName(resolve-QName('p:z', $r)))", "'urn:p' || p_size % 3"),
    "node_names": ("/r/*:a/concat(local-name(.), ' ', namespace-uri(.), ' ', name(.))", "'a urn:p' || p_size % 3 || ' p:a'"),
}
#: name -> (path, namespaces, DuckDB SQL of the documents and values that it finds)
NODE_PATHS = {
    "node_comment": ("/r/comment()", {}, "SELECT p_partkey AS doc, 'note ' || p_size AS value FROM part"),
    "node_pi": ("/r/processing-instruction('pi')", {}, "SELECT p_partkey AS doc, 'data ' || p_size AS value FROM part"),
    "node_text": ("/r/*/text()", {}, "SELECT p_partkey AS doc, 'some &lt; ' || p_brand AS value FROM part"),
    "node_attribute_axis": ("/r/*/attribute::k", {}, "SELECT p_partkey AS doc, p_size::VARCHAR AS value FROM part"),
    "node_element_test": ("/r/element(b)", {}, "SELECT p_partkey AS doc, '' AS value FROM part UNION ALL SELECT p_partkey, '' FROM part WHERE p_size % 7 = 0"),
    "node_prefixed": ("/r/p:a/@k", {"p": "urn:p1"}, "SELECT p_partkey AS doc, p_size::VARCHAR AS value FROM part WHERE p_size % 3 = 1"),
    "node_id": ("id('i3')", {}, "SELECT p_partkey AS doc, 'some &lt; ' || p_brand AS value FROM part WHERE p_size % 5 = 3"),
}


def _node_value(expression: str):
    return lambda spark, folder: _nodes(spark, folder).query(expression).toDF("v")


def _node_path(path: str, namespaces: dict):
    return lambda spark, folder: _nodes(spark, folder, namespaces=namespaces).query(path).select("doc", "value")


def _nodes(spark: SparkSession, folder: str, **static) -> Engine:
    return Engine(spark, **static).nodes(lineage.cut(shred.shred(_parts(spark, folder, DOC))))


def _node_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes some paths find over all documents, by prefixes, kinds and axes."""
    engine, out = _nodes(spark, folder, namespaces={"p": "urn:p1"}), None
    for path in ("/r/p:a", "/r/*:a", "/r/p:*", "/r/@key", "/r/namespace::*", "id('i3')", "/r/node()"):
        found = engine.query(f"count({path})").select(F.lit(path).alias("path"), F.col("item").alias("n"))
        out = found if out is None else out.union(found)
    return out


NODE_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{path}' AS path, {sql}::BIGINT AS n FROM part" for path, sql in (
    ("/r/p:a", "count(*) FILTER (WHERE p_size % 3 = 1)"), ("/r/*:a", "count(*)"), ("/r/p:*", "count(*) FILTER (WHERE p_size % 3 = 1)"), ("/r/@key", "count(*)"), ("/r/namespace::*", "count(*) + count(*) FILTER (WHERE p_size % 2 = 0)"),
    ("id(''i3'')", "count(*) FILTER (WHERE p_size % 5 = 3)"), ("/r/node()", "4 * count(*) + count(*) FILTER (WHERE p_size % 7 = 0)"),
))


def _by_type(spark: SparkSession, folder: str) -> DataFrame:
    """Elements by the types that validation gave them, xsi:type included."""
    schema, xml, _, _ = VALIDATION["xsd_xsi_type"]
    nodes = lineage.cut(shred.shred(_parts(spark, folder, xml)))
    engine = Engine(spark).nodes(lineage.cut(typed_nodes(nodes, validate(spark, nodes, compile_schema(XS.format(schema))))))
    found = engine.query("//element(*, D)").select("doc", F.lit("D").alias("type"))
    return found.union(engine.query("//element(w, xs:integer)").select("doc", F.lit("integer").alias("type")))


def _psvi(spark: SparkSession, folder: str) -> DataFrame:
    schema, xml, _, _ = VALIDATION["xsd_substitution"]
    found = validate(spark, lineage.cut(shred.shred(_parts(spark, folder, xml))), compile_schema(XS.format(schema))).psvi
    return found.where("path <> '/r'").select("doc", "path", "type", "validity")


CLEAN = (
    "concat('<r xmlns:p=\"urn:p\" key=\"', p_partkey, '\"><!--note--><p:a k=\"', p_size, '\">', p_brand, ' &lt; &amp; é</p:a><?pi ', p_size, '?>', CASE WHEN p_size % 2 = 0 THEN '<b></b>' ELSE 'tail' END, '</r>')"
)
MIXED_UP = "CASE p_size % 4 WHEN 0 THEN '<r><a></r>' WHEN 1 THEN concat('<r k=', p_size, '/>') ELSE concat('<r><a>', p_size, '</a></r>') END"


def _serialized(spark: SparkSession, folder: str) -> DataFrame:
    return shred.serialize(lineage.cut(shred.shred(_parts(spark, folder, CLEAN)))).select("doc", "xml")


def _encoded(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in four encodings, told by mark or declaration."""
    xml = f"CASE p_size % 4 WHEN 0 THEN encode({CLEAN}, 'UTF-16') WHEN 1 THEN encode({CLEAN}, 'UTF-16BE') WHEN 2 THEN encode(concat('<?xml version=\"1.0\" encoding=\"iso-8859-1\"?>', {CLEAN}), 'ISO-8859-1') ELSE encode({CLEAN}, 'UTF-8') END"
    nodes = shred.shred(_parts(spark, folder, xml))
    return nodes.where("kind = 'element' and local = 'a'").select("doc", "value")


def _mixed_up(spark: SparkSession, folder: str) -> DataFrame:
    nodes = lineage.cut(shred.shred(_parts(spark, folder, MIXED_UP)))
    sound = nodes.where("kind = 'element' and local = 'a'").select("doc", "value")
    return shred.errors(nodes).select("doc", F.lit("malformed").alias("value")).union(sound)


def _hidden_schema(spark: SparkSession, folder: str) -> DataFrame:
    """What a type's content expects, and the schema's components."""
    schema = compile_schema(XS.format(VALIDATION["xsd_attributes"][0] + '<xs:complexType name="T"><xs:sequence><xs:element name="x"/><xs:choice><xs:element name="y"/><xs:element name="z" minOccurs="0"/></xs:choice></xs:sequence><xs:attribute name="k"/></xs:complexType>'))
    elements, attributes = schema.expected(("", "T"))
    rows = [("component", f"{kind} {name}") for kind, _, name, _ in schema.describe()]
    rows += [("element", e[1]) for e in elements] + [("attribute", a[1]) for a in attributes]
    return spark.createDataFrame(sorted(set(rows)), "what string, name string")


OTHERS = {
    "node_nilled": (_node_value("/r/b/nilled(.)"), "SELECT p_size % 3 = 0 AS v FROM part UNION ALL SELECT false FROM part WHERE p_size % 7 = 0"),
    "node_counts": (_node_counts, NODE_COUNTS_SQL),
    "node_types": (_by_type, "SELECT p_partkey AS doc, 'D' AS type FROM part WHERE p_size % 4 IN (0, 3) UNION ALL SELECT p_partkey, 'integer' FROM part WHERE p_size % 4 = 0"),
    "psvi": (_psvi, "SELECT p_partkey AS doc, '/r/' || CASE p_size % 4 WHEN 0 THEN 'm' WHEN 3 THEN 'h' ELSE 'n' END AS path, CASE p_size % 4 WHEN 0 THEN 'int' WHEN 3 THEN 'integer' ELSE 'positiveInteger' END AS type, CASE WHEN p_size % 4 IN (1, 3) THEN 'invalid' ELSE 'valid' END AS validity FROM part"),
    "serialize": (_serialized, f"SELECT p_partkey AS doc, {CLEAN} AS xml FROM part"),
    "encodings": (_encoded, "SELECT p_partkey AS doc, p_brand || ' < & é' AS value FROM part"),
    "malformed_mixed": (_mixed_up, "SELECT p_partkey AS doc, CASE WHEN p_size % 4 < 2 THEN 'malformed' ELSE p_size::VARCHAR END AS value FROM part"),
    "schema_checks": (_schema_checks, "SELECT * FROM (VALUES " + ", ".join(f"('{name}', '{code}')" for name, _, code in BAD) + ") t(name, code)"),
    "schema_expected": (_hidden_schema, "SELECT * FROM (VALUES ('component', 'element r'), ('component', 'type T'), ('element', 'x'), ('element', 'y'), ('element', 'z'), ('attribute', 'k')) t(what, name)"),
}

#: name -> (query, DuckDB SQL)
QUERIES = {name: (_validated(schema, xml, options), _faults(cases)) for name, (schema, xml, cases, options) in VALIDATION.items()}
QUERIES |= {name: (_validated(schema, xml, options, FILES), _faults(cases)) for name, (schema, xml, cases, options) in COMPOSED.items()}
QUERIES |= {name: (_node_value(expression), f"SELECT {sql} AS v FROM part") for name, (expression, sql) in NODE_VALUES.items()}
QUERIES |= {name: (_node_path(path, namespaces), sql) for name, (path, namespaces, sql) in NODE_PATHS.items()}
QUERIES |= OTHERS
