"""Compiling schemas, validating documents, identity constraints, and streams."""

import pytest

from treequill.operators import content, identity
from treequill.sources import shred
from treequill.streaming import validate as streaming
from treequill.xsd import onepass
from treequill.xsd import schema as X
from treequill.xsd import validate as V

XS = '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" xmlns="urn:t" targetNamespace="urn:t" elementFormDefault="qualified">{}</xs:schema>'
XSI = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'

MAIN = XS.format("""
<xs:element name="root" type="Root"/>
<xs:element name="shape" type="Shape" abstract="true"/><xs:element name="circle" type="Circle" substitutionGroup="shape"/><xs:element name="dot" type="Shape" substitutionGroup="shape"/>
<xs:complexType name="Shape"><xs:attribute name="id" type="xs:ID"/></xs:complexType>
<xs:complexType name="Circle"><xs:complexContent><xs:extension base="Shape"><xs:sequence><xs:element name="r" type="Size"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:simpleType name="Size"><xs:restriction base="xs:decimal"><xs:minExclusive value="0"/></xs:restriction></xs:simpleType>
<xs:simpleType name="Codes"><xs:list itemType="xs:int"/></xs:simpleType>
<xs:complexType name="Base" abstract="true"><xs:sequence><xs:element name="v" type="xs:int"/></xs:sequence></xs:complexType>
<xs:complexType name="Derived"><xs:complexContent><xs:extension base="Base"><xs:sequence><xs:element name="w" type="xs:int" minOccurs="0"/></xs:sequence></xs:extension></xs:complexContent></xs:complexType>
<xs:complexType name="Money"><xs:simpleContent><xs:extension base="Size"><xs:attribute name="unit" type="xs:token" use="required"/></xs:extension></xs:simpleContent></xs:complexType>
<xs:attributeGroup name="common"><xs:attribute name="lang" type="xs:language"/><xs:attribute name="fix" type="xs:string" fixed="yes"/></xs:attributeGroup>
<xs:group name="pair"><xs:sequence><xs:element name="a" type="xs:string"/><xs:element name="b" type="xs:string" nillable="true"/></xs:sequence></xs:group>
<xs:complexType name="Root"><xs:sequence>
  <xs:group ref="pair" minOccurs="0" maxOccurs="2"/>
  <xs:choice minOccurs="0"><xs:element name="x" type="Codes"/><xs:element name="y" type="xs:date" default="2024-01-01"/></xs:choice>
  <xs:element ref="shape" minOccurs="0" maxOccurs="unbounded"/>
  <xs:element name="base" type="Base" minOccurs="0"/>
  <xs:element name="cost" type="Money" minOccurs="0"/>
  <xs:element name="empty" minOccurs="0"><xs:complexType/></xs:element>
  <xs:element name="all" minOccurs="0"><xs:complexType><xs:all><xs:element name="p" type="xs:int"/><xs:element name="q" type="xs:int" minOccurs="0"/></xs:all></xs:complexType></xs:element>
  <xs:element name="ref" type="xs:IDREF" minOccurs="0"/>
  <xs:any namespace="##other" processContents="lax" minOccurs="0"/>
</xs:sequence><xs:attributeGroup ref="common"/><xs:anyAttribute namespace="##other" processContents="skip"/></xs:complexType>
""")

CASES = [
    ("", []), ("<a/><b/><a/><b/>", []), ("<a/><b/><a/>", ["cvc-complex-type.2.4"]), ("<b/><a/>", ["cvc-complex-type.2.4"]), ("<x>1 2</x>", []), ("<x>1 z</x>", ["cvc-datatype-valid"]), ("<y/>", []), ("<y>2024-1-1</y>", ["cvc-datatype-valid"]), ("<x/><y/>", ["cvc-complex-type.2.4"]),
    ("<circle id='i'><r>2</r></circle><dot/>", []), ("<shape/>", ["cvc-complex-type.2.4", "cvc-elt.2"]), ("<circle><r>0</r></circle>", ["cvc-minExclusive-valid"]), ("<dot id='i'/><dot id='i'/>", ["cvc-id.2"]), ("<dot id='i'/><ref>i</ref>", []), ("<ref>nope</ref>", ["cvc-id.1"]),
    ("<base><v>1</v></base>", ["cvc-type.2"]), (f"<base {XSI} xsi:type='Derived'><v>1</v><w>2</w></base>", []), (f"<base {XSI} xsi:type='Nope'><v>1</v></base>", ["cvc-elt.4.2", "cvc-type.2"]), (f"<base {XSI} xsi:type='Circle'><v>1</v></base>", ["cvc-elt.4.3", "cvc-type.2"]),
    ("<cost unit='eur'>5.5</cost>", []), ("<cost>5</cost>", ["cvc-complex-type.4"]), ("<cost unit='eur'>-1</cost>", ["cvc-minExclusive-valid"]), ("<cost unit='eur'><r/></cost>", ["cvc-complex-type.2.2", "cvc-datatype-valid"]), ("<empty/>", []), ("<empty>x</empty>", ["cvc-complex-type.2.1"]),
    ("<all><q>1</q><p>2</p></all>", []), ("<all><q>1</q></all>", ["cvc-complex-type.2.4"]), ("<all><p>1</p><p>1</p></all>", ["cvc-complex-type.2.4"]), ("text", ["cvc-complex-type.2.3"]), ("<o:z xmlns:o='urn:o'><o:any/></o:z>", []), ("<z xmlns=''/>", ["cvc-complex-type.2.4"]),
    (f"<a/><b {XSI} xsi:nil='true'/>", []), (f"<a/><b {XSI} xsi:nil='true'>t</b>", ["cvc-elt.3.2.1"]), (f"<a {XSI} xsi:nil='true'/><b/>", ["cvc-elt.3.1"]), ("<a><b/></a><b/>", ["cvc-type.3.1.2"]),
]
ROOTS = [("<root xmlns='urn:t' lang='en'/>", []), ("<root xmlns='urn:t' lang='e_n'/>", ["cvc-datatype-valid"]), ("<root xmlns='urn:t' fix='no'/>", ["cvc-attribute.4"]), ("<root xmlns='urn:t' nope='1'/>", ["cvc-complex-type.3.2.2"]), ("<root xmlns='urn:t' xmlns:o='urn:o' o:k='1' xml:lang='de'/>", []), ("<root/>", ["cvc-elt.1"]), ("<shape xmlns='urn:t'/>", ["cvc-elt.2"]), ("<root", ["sch-not-well-formed"])]


def codes_of(spark, schema, texts, options=V.Options()):  # noqa: B008
    nodes = shred.shred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")).cache()
    out = [[] for _ in texts]
    for r in V.validate(spark, nodes, schema, options).violations.collect():
        out[r.doc].append(r.code)
    return [sorted(x) for x in out]


def test_instances(spark):
    cases = [(f"<root xmlns='urn:t'>{body}</root>", want) for body, want in CASES] + ROOTS
    got = codes_of(spark, X.compile_schema(MAIN), [c[0] for c in cases])
    for (text, want), found in zip(cases, got, strict=True):
        assert found == sorted(want), text


def test_one_pass_finds_the_same(spark):
    """The pass over events and the joins over node tables agree on code and place."""
    schema = X.compile_schema(MAIN)
    texts = [f"<root xmlns='urn:t'>{body}</root>" for body, _ in CASES] + [r[0] for r in ROOTS]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, xml string")
    one = {(r.doc, r.pre, r.path, r.code, r.message) for r in onepass.violations(docs, schema).collect()}
    two = {(r.doc, r.pre, r.path, r.code, r.message) for r in V.validate(spark, shred.shred(docs).cache(), schema).violations.collect()}
    assert one == two


def test_newer_constructs(spark):
    text = XS.format("""
    <xs:element name="e" type="E"><xs:alternative test="@kind = 'n'" type="N"/><xs:alternative test="@kind = 'x'" type="X"/></xs:element>
    <xs:complexType name="E" mixed="true"><xs:sequence><xs:any processContents="lax" minOccurs="0" maxOccurs="unbounded"/></xs:sequence><xs:anyAttribute processContents="lax"/></xs:complexType>
    <xs:complexType name="N"><xs:complexContent><xs:restriction base="E"><xs:sequence><xs:element name="n" type="xs:int"/></xs:sequence><xs:attribute name="kind" type="xs:token"/></xs:restriction></xs:complexContent></xs:complexType>
    <xs:complexType name="X"><xs:complexContent><xs:restriction base="E"><xs:sequence/><xs:attribute name="kind" type="xs:token"/></xs:restriction></xs:complexContent></xs:complexType>
    <xs:element name="r"><xs:complexType><xs:sequence><xs:element name="low" type="xs:int"/><xs:element name="high" type="xs:int"/></xs:sequence><xs:assert test="t:low &lt;= t:high" xmlns:t="urn:t"/></xs:complexType></xs:element>
    <xs:element name="o"><xs:complexType><xs:openContent mode="suffix"><xs:any namespace="##other" processContents="skip"/></xs:openContent><xs:sequence><xs:element name="k" type="xs:int"/></xs:sequence></xs:complexType></xs:element>
    """)
    texts = [
        ("<e xmlns='urn:t' kind='n'><n>1</n></e>", []), ("<e xmlns='urn:t' kind='n'><n>z</n></e>", ["cvc-datatype-valid"]), ("<e xmlns='urn:t' kind='x'><n>1</n></e>", ["cvc-complex-type.2.1"]), ("<e xmlns='urn:t'><n>z</n>free</e>", []),
        ("<r xmlns='urn:t'><low>1</low><high>2</high></r>", []), ("<r xmlns='urn:t'><low>3</low><high>2</high></r>", ["cvc-assertion"]), ("<o xmlns='urn:t'><k>1</k><p:q xmlns:p='urn:p'/></o>", []), ("<o xmlns='urn:t'><p:q xmlns:p='urn:p'/><k>1</k></o>", ["cvc-complex-type.2.4"]),
    ]
    got = codes_of(spark, X.compile_schema(text), [t[0] for t in texts], V.Options(assertions=True))
    for (xml, want), found in zip(texts, got, strict=True):
        assert found == want, xml


@pytest.mark.parametrize(
    ("body", "code"),
    [
        ("<xs:element name='a' type='Nope'/>", "src-resolve"), ("<xs:element name='a' type='xs:nope'/>", "src-resolve"), ("<xs:element name='a'/><xs:element name='a'/>", "sch-props-correct"), ("<xs:element name='a' default='1' fixed='2'/>", "src-element"),
        ("<xs:complexType name='A'><xs:complexContent><xs:extension base='B'/></xs:complexContent></xs:complexType><xs:complexType name='B'><xs:complexContent><xs:extension base='A'/></xs:complexContent></xs:complexType>", "ct-props-correct.3"),
        ("<xs:complexType name='A'><xs:sequence><xs:element name='a' minOccurs='0'/><xs:element name='a'/></xs:sequence></xs:complexType>", "cos-nonambig"), ("<xs:complexType name='A'><xs:choice><xs:element name='a' type='xs:int'/><xs:sequence><xs:element name='b'/><xs:element name='a' type='xs:date'/></xs:sequence></xs:choice></xs:complexType>", "cos-element-consistent"),
        ("<xs:complexType name='A'><xs:sequence minOccurs='2' maxOccurs='1'/></xs:complexType>", "p-props-correct"), ("<xs:complexType name='A'><xs:sequence><xs:all/></xs:sequence></xs:complexType>", None), ("<xs:simpleType name='S'><xs:restriction base='xs:string'><xs:totalDigits value='2'/></xs:restriction></xs:simpleType>", "cos-applicable-facets"),
        ("<xs:simpleType name='S'><xs:list itemType='L'/></xs:simpleType><xs:simpleType name='L'><xs:list itemType='xs:int'/></xs:simpleType>", "cos-list-of-atomic"), ("<xs:simpleType name='S'><xs:union/></xs:simpleType>", "src-union-memberTypes-or-simpleTypes"), ("<xs:simpleType name='S'><xs:restriction base='S'/></xs:simpleType>", "st-props-correct"),
        ("<xs:complexType name='A'><xs:attribute name='a' type='xs:int'/><xs:attribute name='a' type='xs:int'/></xs:complexType>", "ct-props-correct"), ("<xs:attribute name='a' type='xs:ID' default='x'/>", "a-props-correct"), ("<xs:complexType name='A'><xs:attribute name='a' default='1' use='required'/></xs:complexType>", "src-attribute"), ("<xs:group name='g'><xs:sequence><xs:group ref='g'/></xs:sequence></xs:group>", "mgd-props-correct"),
        ("<xs:element name='h' type='xs:int'/><xs:element name='m' type='xs:string' substitutionGroup='h'/>", "e-props-correct.4"), ("<xs:element name='a'><xs:complexType><xs:sequence/></xs:complexType><xs:key name='k'><xs:selector xpath='a[1]'/><xs:field xpath='.'/></xs:key></xs:element>", "src-identity-constraint"),
        ("<xs:complexType name='B'><xs:sequence><xs:element name='a' type='xs:int'/></xs:sequence></xs:complexType><xs:complexType name='R'><xs:complexContent><xs:restriction base='B'><xs:sequence><xs:element name='z' type='xs:int'/></xs:sequence></xs:restriction></xs:complexContent></xs:complexType>", "derivation-ok-restriction"),
        ("<xs:complexType name='F' final='extension'/><xs:complexType name='G'><xs:complexContent><xs:extension base='F'/></xs:complexContent></xs:complexType>", "cos-ct-extends"),
    ],
)
def test_bad_schemas(body, code):
    if code is None:
        X.compile_schema(XS.format(body))  # an empty all group is no particle
        return
    with pytest.raises(Exception) as e:  # noqa: PT011
        X.compile_schema(XS.format(body))
    assert getattr(e.value, "code", None) == code, e.value


def test_composition(spark):
    files = {
        "types.xsd": '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:simpleType name="Size"><xs:restriction base="xs:int"/></xs:simpleType><xs:element name="size" type="Size"/></xs:schema>',
        "other.xsd": '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema" targetNamespace="urn:o"><xs:attribute name="mark" type="xs:int"/></xs:schema>',
    }
    main = XS.format('<xs:include schemaLocation="types.xsd"/><xs:import namespace="urn:o" schemaLocation="other.xsd"/><xs:element name="e"><xs:complexType><xs:sequence><xs:element ref="size"/></xs:sequence><xs:attribute xmlns:o="urn:o" ref="o:mark"/></xs:complexType></xs:element>')
    found = codes_of(spark, X.compile_schema(main, loader=files), ["<e xmlns='urn:t' xmlns:o='urn:o' o:mark='1'><size>3</size></e>", "<e xmlns='urn:t' xmlns:o='urn:o' o:mark='z'><size>z</size></e>"])
    assert found == [[], ["cvc-datatype-valid", "cvc-datatype-valid"]]
    redefined = XS.format('<xs:redefine schemaLocation="types.xsd"><xs:simpleType name="Size"><xs:restriction base="Size"><xs:maxInclusive value="5"/></xs:restriction></xs:simpleType></xs:redefine>')
    assert codes_of(spark, X.compile_schema(redefined, loader=files), ["<size xmlns='urn:t'>5</size>", "<size xmlns='urn:t'>6</size>"]) == [[], ["cvc-maxInclusive-valid"]]
    overridden = XS.format('<xs:override schemaLocation="types.xsd"><xs:simpleType name="Size"><xs:restriction base="xs:boolean"/></xs:simpleType></xs:override>')
    assert codes_of(spark, X.compile_schema(overridden, loader=files), ["<size xmlns='urn:t'>true</size>"]) == [[]]
    with pytest.raises(X.SchemaError):
        X.compile_schema(XS.format('<xs:import namespace="urn:t"/>'))


def test_describe():
    schema = X.compile_schema(MAIN)
    assert ("element", "urn:t", "root", "Root") in schema.describe()
    elements, attributes = schema.expected(("urn:t", "Root"))
    assert ("urn:t", "circle") in elements and ("urn:t", "shape") not in elements and ("", "lang") in attributes


KEYED = XS.format("""
<xs:element name="r"><xs:complexType><xs:sequence><xs:element name="i" maxOccurs="unbounded"><xs:complexType><xs:attribute name="k" type="xs:int"/><xs:attribute name="to" type="xs:int"/></xs:complexType></xs:element></xs:sequence></xs:complexType>
<xs:key name="k"><xs:selector xpath="t:i" xmlns:t="urn:t"/><xs:field xpath="@k"/></xs:key><xs:keyref name="ref" refer="k"><xs:selector xpath="t:i" xmlns:t="urn:t"/><xs:field xpath="@to"/></xs:keyref></xs:element>
""").replace("<xs:schema ", '<xs:schema xmlns:t="urn:t" ')


def test_identity_over_documents(spark):
    texts = ["<r xmlns='urn:t'><i k='1' to='2'/><i k='2'/></r>", "<r xmlns='urn:t'><i k='1'/><i k='1'/></r>", "<r xmlns='urn:t'><i/></r>", "<r xmlns='urn:t'><i k='1' to='9'/></r>"]
    got = codes_of(spark, X.compile_schema(KEYED), texts, V.Options(identity=True))
    assert got == [[], ["cvc-identity-constraint.4.2.2"], ["cvc-identity-constraint.4.2.1"], ["cvc-identity-constraint.4.3"]]


def test_identity_over_tables(spark):
    t = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, None, 3), (2, None, 4), (3, "b", 5)], "s long, f string, n long")
    assert [(r.s, r.f, r.n) for r in identity.unique(t, ["f"], ["s"]).collect()] == [(1, "a", 2)]
    assert sorted((r.s, r.code) for r in identity.key(t, ["f"], ["s"]).collect()) == [(1, identity.DUPLICATE), (2, identity.INCOMPLETE), (2, identity.DUPLICATE)] or len(identity.key(t, ["f"], ["s"]).collect()) == 3
    targets = spark.createDataFrame([("a",), (None,)], "g string")
    assert [(r.f, r.n) for r in identity.keyref(t, ["f"], targets, ["g"]).collect()] == [("b", 1)]


def test_content_over_tables(spark):
    M = content.Model
    model = M.sequence(M.element("h"), M.choice(M.element("a"), M.element("b")).occurs(1, 2), M.element("f").occurs(0, 1))
    rows = [(1, 1, "h"), (1, 2, "a"), (1, 3, "b"), (2, 1, "a"), (3, 2, "a"), (3, 1, "h"), (4, 1, "h"), (4, 2, "z")]
    found = content.unmatched(spark.createDataFrame(rows, "p long, o long, n string"), "p", ["o"], "n", model)
    assert sorted(r.p for r in found.collect()) == [2, 4]


def test_hints(spark):
    nodes = shred.shred(spark.createDataFrame([(1, f"<a {XSI} xsi:schemaLocation='u1 l1 u2 l2'><b xsi:noNamespaceSchemaLocation=' n.xsd '/></a>")], "doc_id long, xml string"))
    assert sorted(tuple(r) for r in V.hints(nodes).collect()) == [("", "n.xsd"), ("u1", "l1"), ("u2", "l2")]


def test_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "<root xmlns='urn:t'/>"), (2, "<root xmlns='urn:t'><b/></root>")], "doc_id long, xml string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, xml string").parquet(source)
    query = streaming.validated(stream, X.compile_schema(MAIN), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination(120)
    assert [(r.doc, r.code) for r in spark.read.parquet(str(tmp_path / "out/violations")).collect()] == [(2, "cvc-complex-type.2.4")]
    assert spark.read.parquet(str(tmp_path / "out/psvi")).count() == 3
    counted = streaming.nodes(stream).writeStream.format("memory").queryName("tq_nodes_test").trigger(availableNow=True).start()
    counted.awaitTermination(60)
    assert spark.table("tq_nodes_test").where("kind = 'element'").count() == 3


def test_hinted_schemas_are_loaded(spark):
    builder = X.Builder(loader={"n.xsd": '<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a" type="xs:int"/></xs:schema>'})
    docs = spark.createDataFrame([(1, f"<a {XSI} xsi:noNamespaceSchemaLocation='n.xsd'>x</a>"), (2, f"<a {XSI} xsi:noNamespaceSchemaLocation='lost.xsd'>1</a>")], "doc_id long, xml string")
    nodes = shred.shred(docs).cache()
    assert [(r.doc, r.code) for r in V.validate(spark, nodes, V.enriched(nodes, builder)).violations.collect()] == [(1, "cvc-datatype-valid")]


def test_typed_nodes_answer_type_tests(spark):
    from treequill.plans.engine import Engine

    nodes = shred.shred(spark.createDataFrame([(1, "<root xmlns='urn:t'><circle><r>2</r></circle><dot/></root>")], "doc_id long, xml string")).cache()
    typed = V.typed_nodes(nodes, V.validate(spark, nodes, X.compile_schema(MAIN)))
    engine = Engine(spark, default_namespace="urn:t").nodes(typed)
    assert [r.local for r in engine.query("//element(*, Shape)", ordered=True).collect()] == ["circle", "dot"]
    assert [r.local for r in engine.query("//element(*, Circle)").collect()] == ["circle"] and [r.local for r in engine.query("//element(*, decimal)").collect()] == ["r"]
