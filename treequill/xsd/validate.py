"""Validating node tables against a compiled schema.

Types go down the tree level by level: the elements of a depth join their
parents' types with the schema's small tables, so a million documents take as
many steps as one. Every rule is then a predicate, an aggregation or an anti join
over the typed elements; a rule that fails gives a row of code and place.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.functions.values import EMPTY, Val, ebv, fresh, text_literal
from treequill.operators import facets, identity
from treequill.operators.facets import Simple
from treequill.plans.compiler import Compiler, Node, Place, Rel, Static
from treequill.plans.lineage import cut
from treequill.plans.within import Within, found_in
from treequill.sources.shred import XML, XSI
from treequill.types.regex import literal
from treequill.xpath import ast as A
from treequill.xpath.errors import XPathError
from treequill.xpath.parser import parse
from treequill.xsd.content import ELSEWHERE, alphabet, components, content_pattern, simple_of
from treequill.xsd.schema import ANY_TYPE, PROCESS, Builder, Complex, Schema, Type, Wildcard, derives, leaves, wildcards

VIOLATION = ["doc", "pre", "path", "line", "code", "message"]


@dataclass(frozen=True)
class Options:
    """What is checked besides types and content. The defaults are those of a plain run: identity constraints and assertions are asked for."""

    identity: bool = False
    assertions: bool = False
    #: Elements without a declaration at the root are errors.
    strict: bool = True
    #: Attributes of the xml: namespace pass without a declaration.
    xml_attributes: bool = True


@dataclass(frozen=True)
class Result:
    #: (doc, pre, path, line, code, message)
    violations: DataFrame
    #: (doc, pre, path, type, types, nil, validity, attempted); types are the type and all it is derived from.
    psvi: DataFrame


class Validator:
    def __init__(self, spark: SparkSession, schema: Schema, options: Options = Options()) -> None:  # noqa: B008
        self.spark, self.schema, self.options = spark, schema, options
        self.elements, self.types = components(schema)
        if ANY_TYPE not in self.types:
            self.types.append(ANY_TYPE)
        self.element_id = {id(e): i for i, e in enumerate(self.elements)}
        self.type_id = {id(t): i for i, t in enumerate(self.types)}
        self.names = alphabet(schema)

    # The schema as small tables, bounded by its size.

    def small(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, schema))

    def declarations(self) -> DataFrame:
        rows = [(i, self.type_id[id(e.type)], e.nillable, e.abstract, e.fixed, e.default) for i, e in enumerate(self.elements)]
        return self.small(rows, "decl_id int, declared int, nillable boolean, abstract boolean, fixed string, dflt string")

    def globals(self) -> DataFrame:
        rows = [(*n, self.element_id[id(e)]) for n, e in self.schema.elements.items()]
        return self.small(rows, "g_ns string, g_local string, g_decl int")

    def children(self) -> DataFrame:
        rows = []
        for t in self.types:
            if isinstance(t, Complex):
                for p in leaves(t.particle):
                    if p.element is not None:
                        members = self.schema.substitutes(p.element) if p.element.is_global else []
                        rows += [(self.type_id[id(t)], *e.name, self.element_id[id(e)]) for e in {id(x): x for x in (p.element, *members)}.values()]
        return self.small(list(dict.fromkeys(rows)), "c_type int, c_ns string, c_local string, c_decl int")

    def wildcards(self, column: str) -> str:
        """SQL of how the type in ``column`` treats an element (ns, local) that no particle declares: as the loosest wildcard that admits it."""
        branches = {}
        for t in self.types:
            if isinstance(t, Complex) and (found := wildcards(t)):
                tests = [(process, " or ".join(self.admits(w) for w in found if w.process == process)) for process in PROCESS]
                branches[self.type_id[id(t)]] = "case " + " ".join(f"when {test} then '{process}'" for process, test in tests if test) + " end"
        return self.case(column, branches, "cast(null as string)")

    def type_names(self) -> DataFrame:
        rows = [(*q, self.type_id[id(t)]) for q, t in self.schema.types.items() if id(t) in self.type_id]
        return self.small(rows, "t_ns string, t_local string, named int")

    def derived(self) -> DataFrame:
        named = {id(t) for t in self.schema.types.values()}
        rows = [(self.type_id[id(a)], self.type_id[id(b)]) for a in self.types if id(a) in named for b in self.types if derives(a, b)]
        return self.small(rows, "sub int, super int")

    def simple_id(self, kind: Simple | None) -> int | None:
        return None if kind is None else self.type_id.setdefault(id(kind), self._more(kind))

    def _more(self, kind: Simple) -> int:
        if id(kind) in self.type_id:
            return self.type_id[id(kind)]
        self.types.append(kind)
        return len(self.types) - 1

    def attribute_uses(self) -> DataFrame:
        rows = []
        for t in list(self.types):
            if isinstance(t, Complex):
                rows += [(self.type_id[id(t)], *a.name, self.simple_id(a.type), a.required, a.fixed, a.default) for a in t.attributes.values()]
        return self.small(rows, "a_type int, a_ns string, a_local string, a_simple int, required boolean, a_fixed string, a_default string")

    # SQL over the schema's types: one branch for each, so every pattern is a literal.

    def case(self, column: str, branches: dict[int, str], other: str = "null") -> str:
        if not branches:
            return other
        return f"case {column} " + " ".join(f"when {i} then {sql}" for i, sql in branches.items()) + f" else {other} end"

    def simple_case(self, column: str, value: str, ids: set[int]) -> str:
        """The code of the first rule that a value breaks, of the types ``ids`` only: each branch holds a type's whole test."""
        return self.case(column, {i: facets.code_of(value, t, self.schema.version) for i, t in enumerate(self.types) if i in ids and isinstance(t, Simple)}, "cast(null as string)")

    def possible(self) -> list[Type]:
        """Types that an element may get: declared ones, alternatives, and what xsi:type may put in their place."""
        declared = [t for e in self.elements for t in (e.type, *(a[1] for a in e.alternatives)) if t is not None]
        return [t for t in list(self.types) if any(derives(t, d) for d in declared)]

    # Typing.

    def typed(self, nodes: DataFrame) -> DataFrame:
        """The elements with declaration, type, and how they were found."""
        xsi = nodes.where((F.col("kind") == "attribute") & (F.col("ns") == XSI)).groupBy(F.col("doc").alias("x_doc"), F.col("parent").alias("x_pre"))
        xsi = xsi.agg(F.max(F.when(F.col("local") == "type", F.col("value"))).alias("xsi_type"), F.max(F.when(F.col("local") == "nil", F.trim("value"))).alias("xsi_nil"))
        base = nodes.where("kind = 'element'").select("doc", "pre", "post", "parent", "depth", "ns", "local", "value", "path", "line", "ns_bindings")
        name = F.trim("xsi_type")
        prefix = F.when(F.contains(name, F.lit(":")), F.substring_index(name, ":", 1)).otherwise(F.lit(""))
        base = base.join(xsi, (F.col("doc") == F.col("x_doc")) & (F.col("pre") == F.col("x_pre")), "left").drop("x_doc", "x_pre")
        if any(e.alternatives for e in self.elements):
            maps = nodes.where((F.col("kind") == "attribute") & (F.col("ns") == "")).groupBy(F.col("doc").alias("m_doc"), F.col("parent").alias("m_pre"))
            maps = maps.agg(F.map_from_entries(F.collect_list(F.struct("local", "value"))).alias("attrs"))
            base = base.join(maps, (F.col("doc") == F.col("m_doc")) & (F.col("pre") == F.col("m_pre")), "left").drop("m_doc", "m_pre")
        base = base.withColumns({"x_ns": F.when(name.isNotNull(), F.coalesce(F.try_element_at("ns_bindings", prefix), F.lit(""))), "x_local": F.substring_index(name, ":", -1)}).drop("ns_bindings")
        base = cut(base)
        level = base.where("depth = 1").join(self.globals(), (F.col("ns") == F.col("g_ns")) & (F.col("local") == F.col("g_local")), "left")
        level = level.withColumns({"decl_id": F.col("g_decl"), "process": F.lit("strict" if self.options.strict else "lax")}).drop("g_ns", "g_local", "g_decl")
        deepest = base.agg(F.max("depth")).first()[0] or 0
        out = level = cut(self.assigned(level))
        for depth in range(2, deepest + 1):
            above = level.where("type_id is not null").select(F.col("doc").alias("p_doc"), F.col("pre").alias("p_pre"), F.col("type_id").alias("p_type"))
            below = base.where(F.col("depth") == depth).join(above, (F.col("doc") == F.col("p_doc")) & (F.col("parent") == F.col("p_pre")))
            below = below.join(self.children(), (F.col("p_type") == F.col("c_type")) & (F.col("ns") == F.col("c_ns")) & (F.col("local") == F.col("c_local")), "left")
            below = below.withColumn("w_process", F.expr(self.wildcards("p_type")))
            below = below.join(self.globals(), (F.col("ns") == F.col("g_ns")) & (F.col("local") == F.col("g_local")), "left")
            by_wildcard = F.col("c_decl").isNull() & F.col("w_process").isNotNull()
            below = below.withColumns({
                "decl_id": F.when(F.col("c_decl").isNotNull(), F.col("c_decl")).when(by_wildcard & (F.col("w_process") != "skip"), F.col("g_decl")),
                "process": F.when(F.col("c_decl").isNotNull(), F.lit("strict")).when(by_wildcard, F.col("w_process")).otherwise(F.lit("none")),
            })
            level = cut(self.assigned(below.select(*base.columns, "decl_id", "process")))
            out = out.unionByName(level)
        return out

    def assigned(self, level: DataFrame) -> DataFrame:
        """The type in force: xsi:type's if it fits, else the first alternative's that holds, else the declared one."""
        level = level.join(self.declarations().withColumnRenamed("decl_id", "_decl"), F.col("decl_id") == F.col("_decl"), "left").drop("_decl")
        level = level.withColumn("declared", F.coalesce(self.alternative(), F.col("declared")))
        level = level.join(self.type_names(), (F.col("x_ns") == F.col("t_ns")) & (F.col("x_local") == F.col("t_local")), "left").drop("t_ns", "t_local")
        level = level.join(self.derived(), (F.col("named") == F.col("sub")) & (F.col("declared") == F.col("super")), "left")
        fits = F.col("named").isNotNull() & (F.col("declared").isNull() | F.col("sub").isNotNull())
        any_type = F.lit(self.type_id[id(ANY_TYPE)])
        kind = F.when(fits, F.col("named")).otherwise(F.coalesce("declared", F.when(F.col("process") == "lax", any_type)))
        return level.withColumns({"type_id": kind, "x_fits": fits}).drop("sub", "super", "named")

    def alternative(self):
        """The type that an element's alternatives choose; tests see attributes only, so they are SQL over an attribute map."""
        branches = []
        for i, e in enumerate(self.elements):
            for test, kind, scope in e.alternatives:
                if test is None:
                    branches.append((i, "true", self.type_id[id(kind)]))
                else:
                    branches.append((i, self.attribute_test(test, scope), self.type_id[id(kind)]))
        if not branches:
            return F.lit(None).cast("int")
        sql = "case " + " ".join(f"when decl_id = {i} and ({test}) then {kind}" for i, test, kind in branches) + " end"
        return F.expr(sql)

    def attribute_test(self, test: str, scope: dict[str, str]) -> str:
        """A type alternative's test over the column ``attrs``, a map from name to text."""
        tree = parse(test)
        class Attributes(Compiler):
            def relation(self, e, place):
                return None

            def v_Path(self, e, place):
                step = e.steps[0] if len(e.steps) == 1 else None
                if not isinstance(step, A.Step) or step.axis != "attribute" or step.predicates:
                    raise XPathError("src-ct-alternative", f"{test!r} reads more than attributes")
                return Val(f"try_element_at(attrs, {text_literal(step.test.local)})", "untyped", node=True)

        return ebv(Attributes(Static()).value(tree, Place(Static(), item=EMPTY)))

    # Rules.

    def validate(self, nodes: DataFrame) -> Result:
        self.attribute_uses()  # numbers the types of attributes
        typed = cut(self.typed(nodes))
        found = [self.malformed(nodes), self.element_rules(typed), self.content_rules(typed, nodes), self.value_rules(typed, nodes), self.attribute_rules(typed, nodes)]
        found.append(self.reference_rules(typed, nodes))
        identity_ = self.options.identity and any(e.constraints for e in self.elements)
        assertions = self.options.assertions and any(isinstance(t, Complex) and t.assertions for t in self.types)
        valued = self.with_types(nodes, typed) if identity_ or assertions else nodes
        if identity_:
            found += self.identity_rules(valued, typed)
        if assertions:
            found += self.assertion_rules(valued)
        violations = found[0]
        for f in found[1:]:
            violations = violations.unionByName(f)
        violations = cut(violations)
        bad = violations.select(F.col("doc").alias("_d"), F.col("pre").alias("_p")).distinct()
        chain = lambda t: list(t.ancestors) if isinstance(t, Simple) else [c.name for c in t.chain()]
        names = self.small([(i, t.name, chain(t)) for i, t in enumerate(self.types)], "_t int, type string, types array<string>")
        psvi = typed.join(names, F.col("type_id") == F.col("_t"), "left").join(bad, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
        validity = F.when(F.col("_p").isNotNull(), F.lit("invalid")).when(F.col("type_id").isNull(), F.lit("notKnown")).otherwise(F.lit("valid"))
        attempted = F.when(F.col("type_id").isNull(), F.lit("none")).otherwise(F.lit("full"))
        psvi = psvi.select("doc", "pre", "path", "type", "types", F.coalesce(F.col("xsi_nil").isin("true", "1"), F.lit(False)).alias("nil"), validity.alias("validity"), attempted.alias("attempted"))
        return Result(violations, psvi)

    def rows(self, df: DataFrame, code: str, message) -> DataFrame:
        """Violations from typed rows with a column of codes; rows without a code pass."""
        return df.withColumn("code", F.expr(code)).where("code is not null").select("doc", "pre", "path", "line", "code", message.alias("message"))

    def malformed(self, nodes: DataFrame) -> DataFrame:
        return nodes.where("kind = 'error'").select("doc", "pre", "path", "line", F.lit("sch-not-well-formed").alias("code"), F.col("value").alias("message"))

    def element_rules(self, typed: DataFrame) -> DataFrame:
        abstract = self.case("type_id", {i: "'cvc-type.2'" for i, t in enumerate(self.types) if isinstance(t, Complex) and t.abstract}, "cast(null as string)")
        tests = (
            "array_compact(array(case when decl_id is null and process = 'strict' and type_id is null then 'cvc-elt.1' end, case when abstract then 'cvc-elt.2' end, "
            "case when xsi_nil is not null and decl_id is not null and not nillable then 'cvc-elt.3.1' end, "
            "case when x_local is not null and not x_fits then case when known then 'cvc-elt.4.3' else 'cvc-elt.4.2' end end, " + abstract + "))"
        )
        names = self.type_names().select("t_ns", "t_local", F.lit(True).alias("known"))
        met = typed.join(names, (F.col("x_ns") == F.col("t_ns")) & (F.col("x_local") == F.col("t_local")), "left").withColumn("known", F.coalesce("known", F.lit(False)))
        found = met.select("doc", "pre", "path", "line", "local", F.explode(F.expr(tests)).alias("code"))
        return found.select("doc", "pre", "path", "line", "code", F.concat(F.lit("element "), "local").alias("message"))

    def content_rules(self, typed: DataFrame, nodes: DataFrame) -> DataFrame:
        """Children's characters in document order against the type's pattern, and text where none may stand."""
        names = self.small([(*n, c) for n, c in self.names.known.items()], "n_ns string, n_local string, sym string")
        spaces = self.small([(ns, c) for ns, c in self.names.unknown.items() if ns != ELSEWHERE], "s_ns string, other string")
        kids = nodes.where("kind = 'element' and depth > 1").select("doc", "parent", "pre", "ns", "local")
        kids = kids.join(names, (F.col("ns") == F.col("n_ns")) & (F.col("local") == F.col("n_local")), "left").join(spaces, F.col("ns") == F.col("s_ns"), "left")
        symbol = F.coalesce("sym", "other", F.lit(self.names.unknown[ELSEWHERE]))
        words = kids.groupBy(F.col("doc").alias("k_doc"), F.col("parent").alias("k_pre"))
        words = words.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", symbol.alias("s")))), lambda x: x["s"]), "").alias("word"))
        texts = nodes.where("kind = 'text'").groupBy(F.col("doc").alias("t_doc"), F.col("parent").alias("t_pre"))
        texts = texts.agg(F.max(F.when(F.col("value").rlike(r"[^ \t\r\n]"), 2).otherwise(1)).alias("text"))
        met = typed.where("type_id is not null").join(words, (F.col("doc") == F.col("k_doc")) & (F.col("pre") == F.col("k_pre")), "left")
        met = met.join(texts, (F.col("doc") == F.col("t_doc")) & (F.col("pre") == F.col("t_pre")), "left").withColumns({"word": F.coalesce("word", F.lit("")), "text": F.coalesce("text", F.lit(0))})
        nil = "(xsi_nil in ('true', '1') and nillable)"
        branches = {}
        for t in [*self.possible(), ANY_TYPE]:
            i = self.type_id[id(t)]
            if isinstance(t, Simple):
                branches[i] = "case when word <> '' then 'cvc-type.3.1.2' end"
            elif t.content == "simple":
                branches[i] = "case when word <> '' then 'cvc-complex-type.2.2' end"
            elif t.content == "empty":
                branches[i] = "case when word <> '' or text > 0 then 'cvc-complex-type.2.1' end"
            else:
                text = "when text > 1 then 'cvc-complex-type.2.3' " if t.content == "element" else ""
                branches[i] = f"case when not word rlike {literal(content_pattern(t, self.schema, self.names))} then 'cvc-complex-type.2.4' {text}end"
        code = f"case when {nil} then case when word <> '' or text > 0 then 'cvc-elt.3.2.1' end else {self.case('type_id', branches, 'cast(null as string)')} end"
        return self.rows(met, code, F.concat(F.lit("content of "), "local"))

    def value_rules(self, typed: DataFrame, nodes: DataFrame) -> DataFrame:
        """Text of simple types and simple content; an empty element takes its default or fixed value."""
        simple = {self.type_id[id(t)]: self.simple_id(simple_of(t)) for t in self.possible() if simple_of(t) is not None}
        met = typed.withColumn("simple_id", F.expr(self.case("type_id", {i: str(s) for i, s in simple.items()}, "cast(null as int)"))).where("simple_id is not null and not coalesce(xsi_nil in ('true', '1'), false)")
        met = met.withColumn("value", F.when(F.col("value") == "", F.coalesce("fixed", "dflt", F.lit(""))).otherwise(F.col("value")))
        fixed = "btrim(value, ' \\t\\n\\r') <> btrim(fixed, ' \\t\\n\\r')"
        numeric = "try_cast(btrim(value) as decimal(38, 18)) = try_cast(btrim(fixed) as decimal(38, 18))"
        decimal = [str(i) for i, t in enumerate(self.types) if i in simple.values() and isinstance(t, Simple) and t.variety == "atomic" and t.primitive == "decimal"]
        same = f"not coalesce(simple_id in ({', '.join(decimal) or '-1'}) and {numeric}, false)"
        code = f"coalesce({self.simple_case('simple_id', 'value', set(simple.values()))}, case when fixed is not null and {fixed} and {same} then 'cvc-elt.5.2.2.2' end)"
        return self.rows(met, code, F.concat(F.lit("value of "), "local"))

    def attribute_rules(self, typed: DataFrame, nodes: DataFrame) -> DataFrame:
        owners = typed.where("type_id is not null").select(F.col("doc").alias("o_doc"), F.col("pre").alias("o_pre"), "type_id", F.col("path").alias("o_path"), F.col("line").alias("o_line"))
        own = nodes.where((F.col("kind") == "attribute") & (F.col("ns") != XSI)).select("doc", "parent", "pre", "ns", "local", "value", "path", "line")
        uses = self.attribute_uses()
        met = own.join(owners, (F.col("doc") == F.col("o_doc")) & (F.col("parent") == F.col("o_pre")))
        met = met.join(uses, (F.col("type_id") == F.col("a_type")) & (F.col("ns") == F.col("a_ns")) & (F.col("local") == F.col("a_local")), "left")
        # An attribute that only a wildcard admits has its global declaration's type.
        known = self.small([(*n, self.simple_id(a.type)) for n, a in self.schema.attributes.items()], "b_ns string, b_local string, b_simple int")
        met = met.join(known, (F.col("ns") == F.col("b_ns")) & (F.col("local") == F.col("b_local")), "left")
        wild = {i: t.any_attribute for i, t in enumerate(self.types) if isinstance(t, Complex) and t.any_attribute is not None}
        admitted = self.case("type_id", {i: self.admits(w) for i, w in wild.items()}, "false")
        process = self.case("type_id", {i: f"'{w.process}'" for i, w in wild.items()}, "cast(null as string)")
        xml = f"ns = '{XML}'" if self.options.xml_attributes else "false"
        used = {self.simple_id(a.type) for t in list(self.types) if isinstance(t, Complex) for a in t.attributes.values()}
        used_globals = {self.simple_id(a.type) for a in self.schema.attributes.values()}
        decimal = [str(i) for i in used if isinstance(t := self.types[i], Simple) and t.variety == "atomic" and t.primitive == "decimal"]
        equal = f"coalesce(a_simple in ({', '.join(decimal) or '-1'}) and try_cast(btrim(value) as decimal(38, 18)) = try_cast(btrim(a_fixed) as decimal(38, 18)), false)"
        code = (
            f"case when a_type is null and not ({admitted}) and not ({xml}) then 'cvc-complex-type.3.2.2' "
            f"when a_type is null and {process} = 'strict' and b_simple is null and not ({xml}) then 'cvc-assess-attr.1.2' "
            f"when a_type is not null then coalesce({self.simple_case('a_simple', 'value', used)}, case when a_fixed is not null and btrim(value) <> btrim(a_fixed) and not {equal} then 'cvc-attribute.4' end) "
            f"when coalesce({process}, 'skip') <> 'skip' and b_simple is not null then {self.simple_case('b_simple', 'value', used_globals)} end"
        )
        found = self.rows(met, code, F.concat(F.lit("attribute "), "local"))
        have = own.select(F.col("doc").alias("h_doc"), F.col("parent").alias("h_pre"), F.col("ns").alias("h_ns"), F.col("local").alias("h_local"))
        wanted = owners.join(uses.where("required"), F.col("type_id") == F.col("a_type"))
        lost = wanted.join(have, (F.col("o_doc") == F.col("h_doc")) & (F.col("o_pre") == F.col("h_pre")) & (F.col("a_ns") == F.col("h_ns")) & (F.col("a_local") == F.col("h_local")), "left_anti")
        return found.unionByName(lost.select(F.col("o_doc").alias("doc"), F.col("o_pre").alias("pre"), F.col("o_path").alias("path"), F.col("o_line").alias("line"), F.lit("cvc-complex-type.4").alias("code"), F.concat(F.lit("attribute "), "a_local").alias("message")))

    def admits(self, w: Wildcard) -> str:
        kind, *rest = w.namespaces
        listed = lambda: ", ".join(text_literal(n) for n in sorted(rest[0]))
        out = {"any": lambda: "true", "other": lambda: f"ns not in ('', {text_literal(rest[0])})", "in": lambda: f"ns in ({listed()})", "not": lambda: f"ns not in ({listed()})"}[kind]()
        for ns, local in w.not_names:
            out += f" and not (ns = {text_literal(ns)} and local = {text_literal(local)})"
        return f"({out})"

    def reference_rules(self, typed: DataFrame, nodes: DataFrame) -> DataFrame:
        """ID, IDREF and IDREFS values of elements and attributes, unique and resolved in each document."""
        kinds = {i: next((n for n in ("ID", "IDREF", "IDREFS") if n in t.ancestors), None) for i, t in enumerate(self.types) if isinstance(t, Simple)}
        branches = {i: f"'{k}'" for i, k in kinds.items() if k}
        simple = {i: self.simple_id(simple_of(t)) for i, t in enumerate(list(self.types)) if simple_of(t) is not None}
        of_element = {i: branches[s] for i, s in simple.items() if s in branches}
        elements = typed.select("doc", "pre", F.expr(self.case("type_id", of_element, "cast(null as string)")).alias("kind"), "value").where("kind is not null")
        owners = typed.where("type_id is not null").select(F.col("doc").alias("o_doc"), F.col("pre").alias("o_pre"), "type_id")
        attributes = nodes.where("kind = 'attribute'").select("doc", "parent", "pre", "ns", "local", "value").join(owners, (F.col("doc") == F.col("o_doc")) & (F.col("parent") == F.col("o_pre")))
        attributes = attributes.join(self.attribute_uses(), (F.col("type_id") == F.col("a_type")) & (F.col("ns") == F.col("a_ns")) & (F.col("local") == F.col("a_local")))
        attributes = attributes.select("doc", "pre", F.expr(self.case("a_simple", branches, "cast(null as string)")).alias("kind"), "value").where("kind is not null")
        found = identity.id_violations(elements.union(attributes))
        return found.select("doc", "pre", F.lit("").alias("path"), F.lit(None).cast("int").alias("line"), "code", "message")

    def with_types(self, nodes: DataFrame, typed: DataFrame) -> DataFrame:
        """The node table with the types of elements' and attributes' values, by which assertions and identity constraints compare, and in ``_of`` the numbers of elements' types."""
        chain = lambda t: list(t.ancestors) if isinstance(t, Simple) else []
        names = self.small([(i, chain(simple_of(t))) for i, t in enumerate(self.types) if simple_of(t) is not None], "_t int, _types array<string>")
        owners = typed.where("type_id is not null").select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), "type_id")
        own = nodes.where("kind = 'attribute'").select("doc", "parent", "pre", "ns", "local").join(owners, (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_p")))
        own = own.join(self.attribute_uses(), (F.col("type_id") == F.col("a_type")) & (F.col("ns") == F.col("a_ns")) & (F.col("local") == F.col("a_local")))
        every = owners.select("_d", "_p", "type_id", F.col("type_id").alias("_of")).union(own.select("doc", "pre", "a_simple", F.lit(None).cast("int"))).join(names, F.col("type_id") == F.col("_t"), "left").select("_d", "_p", "_types", "_of")
        met = nodes.join(every, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
        return cut(met.withColumn("types", F.coalesce("_types", "types")).select(*nodes.columns, "_of"))

    def static(self, nodes: DataFrame, scope: dict[str, str], default: str = "") -> Static:
        view = fresh("tq_valid")
        nodes.createOrReplaceTempView(view)
        out = Static(nodes=view, default_namespace=default, typed=True)
        out.namespaces.update({k: v for k, v in scope.items() if k})
        return out

    def identity_rules(self, nodes: DataFrame, typed: DataFrame) -> list[DataFrame]:
        out = []
        for e in self.elements:
            if not e.constraints:
                continue
            static = self.static(nodes, {**e.constraints[0][5], "_own": e.name[0]})
            scope = f"//{'_own:' if e.name[0] else ''}{e.name[1]}"
            constraints = [identity.Constraint(kind, name, scope, selector, fields, refer) for kind, name, selector, fields, refer, _ in e.constraints]
            found = identity.violations(self.spark, static, constraints)
            out.append(found.select("doc", "pre", F.lit(f"//{e.name[1]}").alias("path"), F.lit(None).cast("int").alias("line"), "code", "message"))
        return out

    def assertion_rules(self, nodes: DataFrame) -> list[DataFrame]:
        """Assertions in the context of each element of their type: those of one type read its elements in one pass over each document."""
        out = []
        for i, t in enumerate(self.types):
            if not isinstance(t, Complex) or not t.assertions:
                continue
            asked, sqls, read = Within(fresh("tq_asserted"), marked="_marked"), [], {"pre", "path", "line"}
            for test, scope in t.assertions:
                static = self.static(nodes, scope, scope.get("", ""))
                compiler, alias = Compiler(static), fresh("n")
                compiler.within[alias] = asked
                place = Place(static, item=Node(alias), vars={"value": Node(alias)}, where=True)
                rel, value = compiler.with_beside(Rel((f"`{asked.view}` {alias}",), (), Node(alias)), lambda compiler=compiler, place=place, test=test: compiler.value(parse(test), place))  # type: ignore[misc]
                sqls.append(rel.also(f"NOT ({ebv(value)})").sql(f"{alias}.doc, {alias}.pre, {alias}.path, {alias}.line, 'cvc-assertion' AS code, {text_literal(test)} AS message"))
                read |= set(re.findall(rf"\b{alias}\.(\w+)", sqls[-1]))
            cut(found_in(nodes.withColumn("_marked", F.col("_of").eqNullSafe(i)), asked, read)).createOrReplaceTempView(asked.view)
            out += [self.spark.sql(sql) for sql in sqls]
        return out


def validate(spark: SparkSession, nodes: DataFrame, schema: Schema, options: Options = Options()) -> Result:  # noqa: B008
    """Violations and typed elements of a node table (see ``treequill.sources.shred``)."""
    return Validator(spark, schema, options).validate(nodes)


def hints(nodes: DataFrame) -> DataFrame:
    """Distinct (namespace, location) of the documents' schema hints: the first of two passes, before more schemas are loaded."""
    own = nodes.where((F.col("kind") == "attribute") & (F.col("ns") == XSI))
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    listed = own.where("local = 'schemaLocation'").select(words.alias("w")).where("size(w) >= 2")
    listed = listed.select(F.explode(F.expr("transform(sequence(0, size(w) div 2 - 1), i -> struct(w[2 * i] as namespace, w[2 * i + 1] as location))")).alias("p")).select("p.namespace", "p.location")
    bare = own.where("local = 'noNamespaceSchemaLocation'").select(F.lit("").alias("namespace"), F.trim("value").alias("location"))
    return listed.union(bare).distinct()


def enriched(nodes: DataFrame, builder: Builder) -> Schema:
    """The second pass: the builder's schemas and those that the documents hint at and the loader has, compiled.

    Hints are collected as distinct pairs: as many as there are schemas, not documents.
    """
    for namespace, location in hints(nodes).collect():
        text = builder.loader(location)
        if text is not None and (location, namespace) not in builder.loaded:
            builder.loaded.add((location, namespace))
            builder.add(text, location)
    return builder.compile()


def typed_nodes(nodes: DataFrame, result: Result) -> DataFrame:
    """The node table with each element's types, which the tests element(name, type) of paths look at."""
    found = result.psvi.where("types is not null").select(F.col("doc").alias("_d"), F.col("pre").alias("_p"), F.col("types").alias("_types"))
    met = nodes.join(found, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), "left")
    return met.withColumn("types", F.coalesce("_types", "types")).select(*nodes.columns)


def strictly(options: Options) -> Options:
    """All checks on."""
    return replace(options, identity=True, assertions=True)
