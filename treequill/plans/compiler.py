"""XPath expressions to SQL.

Two kinds of documents stand under one language. A registered table is the
document ``/table/row/column``: a row is an element, its columns are typed
children, a null column is an absent child. Shredded XML is a node table; each
step of a path is a predicate between two node aliases.

A path is a relation; everything else is an expression in some relation's row.
Where an expression holds a path, the path becomes a correlated subquery:
EXISTS for tests, a lateral aggregate for aggregates, a lateral array for what
else takes a sequence. Catalyst turns them into semi and anti joins and grouped joins, so
quantifiers, nested loops and correlated sums never run row by row. Paths that
only test nothing and read nothing cost nothing: unread columns are pruned.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from treequill.functions import datetimes, sequences, strings  # noqa: F401  (they register functions)
from treequill.functions.registry import Catalog
from treequill.functions.values import (
    EMPTY, GENERAL, NUMERIC, OF_XS, SQL_OF, Val, arithmetic, boolean, canonical_text, cast, castable, ebv, error, first, fresh, general_compare, integer, items_of, negative, of_literal, one, string,
    text_literal, truth, typed_items, unequal, value_compare, as_text,
)
from treequill.plans.within import Hop, Within
from treequill.types import lexical
from treequill.xpath import ast as A
from treequill.xpath.errors import XPathError
from treequill.xpath.parser import REVERSE, parse


@dataclass(frozen=True)
class Table:
    view: str
    #: XPath type of each column.
    columns: dict[str, str]
    #: Columns that give document order; position needs them.
    order: tuple[str, ...] = ()
    #: Gives SQL literals that cut the first order column into stretches of like size; without them numbering is one global window.
    bounds: Callable[[], list[str]] | None = field(default=None, compare=False)


@dataclass
class Static:
    """What is known before any data: documents, names, the catalog and the dialect."""

    tables: dict[str, Table] = field(default_factory=dict)
    #: The view of the node table, if there is one.
    nodes: str | None = None
    #: Are the nodes shredded from documents at hand? Then paths are walked where a document is read.
    documents: bool = False
    namespaces: dict[str, str] = field(default_factory=lambda: {"xs": "http://www.w3.org/2001/XMLSchema", "xml": "http://www.w3.org/XML/1998/namespace"})
    #: The namespace of unprefixed element names.
    default_namespace: str = ""
    base_uri: str | None = None
    mode: str = "2.0"
    #: "step": positions run over all that a step finds in a document; "w3c": over what it finds from one context node.
    positional: str = "step"
    #: Do nodes compare by the types that validation gave them?
    typed: bool = False
    catalog: Catalog = field(default_factory=Catalog)
    variables: dict[str, Val] = field(default_factory=dict)

    def namespace(self, prefix: str) -> str:
        if prefix not in self.namespaces:
            raise XPathError("XPST0081", f"unknown prefix {prefix!r}")
        return self.namespaces[prefix]


@dataclass(frozen=True)
class Row:
    """A row element of a table."""

    alias: str
    table: str


@dataclass(frozen=True)
class Node:
    alias: str


Item = Val | Row | Node


@dataclass(frozen=True)
class Place:
    """Where an expression is evaluated."""

    static: Static
    item: Item | None = None
    vars: dict[str, Item] = field(default_factory=dict)
    position: Val | None = None
    last: Val | None = None
    #: Is it a WHERE clause? Only there may EXISTS stand.
    where: bool = False

    def bind(self, name: str, item: Item) -> Place:
        return replace(self, vars={**self.vars, name: item})


@dataclass(frozen=True)
class Rel:
    """Items by rows: FROM and WHERE so far, the item of a row, and document order."""

    frm: tuple[str, ...]
    where: tuple[str, ...]
    item: Item
    order: tuple[str, ...] = ()
    #: Axis direction of the last step.
    reverse: bool = False
    #: The members of a sequence constructor in a FLWOR body, for results by columns.
    members: tuple[Val, ...] = ()

    def sql(self, select: str, tail: str = "") -> str:
        where = f" WHERE {' AND '.join(self.where)}" if self.where else ""
        return f"SELECT {select} FROM {', '.join(self.frm)}{where}{tail}"

    def also(self, *conditions: str) -> Rel:
        return replace(self, where=(*self.where, *conditions))


_AGGREGATES = {"count", "sum", "avg", "min", "max", "exists", "empty", "not", "boolean", "string-join"}
_PASS = {"data", "unordered", "trace", "distinct-values", "subsequence", "reverse", "zero-or-one", "one-or-more", "exactly-one"}
_KINDS = {"text": "text", "comment": "comment", "processing-instruction": "pi", "element": "element", "attribute": "attribute", "document-node": "document", "schema-element": "element", "schema-attribute": "attribute"}


def _local(name: str) -> str:
    return name.removeprefix("fn:")


def _uses_position(e: object) -> bool:
    """Does the expression call position() or last() for its own context?"""
    if isinstance(e, A.Call) and _local(e.name) in ("position", "last"):
        return True
    if isinstance(e, A.Step | A.Filter):
        return isinstance(e, A.Filter) and _uses_position(e.primary)
    if isinstance(e, A.Path):
        return bool(e.steps) and not isinstance(e.steps[0], A.Step) and _uses_position(e.steps[0])
    return any(_uses_position(x) for x in (e if isinstance(e, tuple) else [getattr(e, n) for n in getattr(e, "__dataclass_fields__", ())]))


class Compiler:
    def __init__(self, static: Static) -> None:
        self.static = static
        #: Lateral subqueries that the expressions being compiled need beside their row, innermost row last.
        self.beside: list[list[str]] = []
        #: By alias, the relations that are found in one pass over each document; the engine makes their views.
        self.within: dict[str, Within] = {}

    def lateral(self, sql: str) -> str | None:
        """The name of the one value of a subquery as a column beside the current row; None outside of any."""
        if not self.beside:
            return None
        alias = fresh("h")
        self.beside[-1].append(f"LATERAL ({sql}) {alias}")
        return f"{alias}.v"

    def with_beside(self, rel: Rel, compile_) -> tuple[Rel, Val]:
        """What ``compile_`` makes in the rows of ``rel``, and ``rel`` with what that needs beside them."""
        self.beside.append([])
        try:
            value = compile_()
        finally:
            needed = self.beside.pop()
        return (replace(rel, frm=(*rel.frm, *needed)) if needed else rel), value

    # Relations.

    def relation(self, e: A.Expr, place: Place) -> Rel | None:
        """``e`` as a relation, if it reads a document; None if it is an expression in the row."""
        if isinstance(e, A.Path):
            return self.path(e, place)
        if isinstance(e, A.Filter):
            rel = self.relation(e.primary, place)
            return None if rel is None else self.predicates(rel, e.predicates, place)
        if isinstance(e, A.Binary) and e.op in ("union", "|", "intersect", "except"):
            return self.set_operation(e, place)
        if isinstance(e, A.For):
            return self.loop(e, place)
        if isinstance(e, A.Sequence) and any(self.relation(x, place) is not None for x in e.items):
            return self.concatenation(e, place)
        if isinstance(e, A.Call) and _local(e.name) in _PASS and e.args and (rel := self.relation(e.args[0], place)) is not None:
            return self.pass_through(_local(e.name), rel, e.args[1:], place)
        if isinstance(e, A.Call) and _local(e.name) == "collection" and len(e.args) == 1 and isinstance(e.args[0], A.Literal) and e.args[0].value in self.static.tables:
            return self.table(str(e.args[0].value))
        if isinstance(e, A.Call) and _local(e.name) == "id" and self.static.nodes and e.args:
            return self.by_id(e, place)
        return None

    def table(self, name: str) -> Rel:
        table = self.static.tables[name]
        alias = fresh("r")
        return Rel((f"`{table.view}` {alias}",), (), Row(alias, name), tuple(f"{alias}.`{c}`" for c in table.order))

    def path(self, e: A.Path, place: Place) -> Rel | None:
        steps = list(self.fused(e.steps))
        if e.absolute:
            if len(steps) >= 2 and self.is_table(steps[0]) and isinstance(steps[1], A.Step) and isinstance(steps[1].test, A.NameTest) and steps[1].test.local in ("row", "*"):
                rel = self.predicates(self.table(steps[0].test.local), steps[1].predicates, place)
                return self.walk(rel, steps[2:], place)
            if self.static.nodes is None:
                raise XPathError("XPDY0002", "no document holds this path")
            if self.static.documents and not isinstance(place.item, Node):
                return self.in_documents(steps, place)
            same = (f"{{n}}.doc = {place.item.alias}.doc",) if isinstance(place.item, Node) else ()
            if not steps:
                return self.node_rel("{n}.kind = 'document'", same)
            if isinstance(steps[0], A.Step) and steps[0].axis in ("descendant", "descendant-or-self"):
                # From the root every node of the document is a descendant: no join at all.
                test = self.node_test(steps[0].test, steps[0].axis)
                inner = "{n}.kind NOT IN ('attribute', 'namespace')" + (" AND {n}.kind <> 'document'" if steps[0].axis == "descendant" else "")
                rel = self.predicates(self.node_rel(f"{inner} AND {test}", same), steps[0].predicates, place)
                return self.walk(rel, steps[1:], place)
            return self.walk(self.node_rel("{n}.kind = 'document'", same), steps, place)
        start = steps[0]
        if isinstance(start, A.Step):
            if isinstance(place.item, Node):
                return self.walk(None, steps, place)
            if place.item is None:
                raise XPathError("XPDY0002", "there is no context item")
            return None
        rel = self.relation(start, place)
        if rel is not None:
            return self.walk(rel, steps[1:], place)
        if isinstance(start, A.Var | A.Context):
            item = place.vars.get(start.name) if isinstance(start, A.Var) else place.item
            if isinstance(item, Node):
                return self.walk(None, steps[1:], replace(place, item=item)) if len(steps) > 1 else None
        return None

    def in_documents(self, steps: list[A.Expr], place: Place) -> Rel | None:
        """An absolute path: its steps are walked in the documents up to the first predicate or step that needs more than the document's nodes."""
        hops: list[Hop] = []
        rest: list[A.Expr] = list(steps)
        predicates: tuple[A.Expr, ...] = ()
        while rest and isinstance(rest[0], A.Step) and not predicates:
            hop = self.hop(rest[0])
            if hop is None and not (self.static.positional == "w3c" and any(self.positional(p) for p in rest[0].predicates)):
                predicates, hop = rest[0].predicates, self.hop(replace(rest[0], predicates=()))
            if hop is None:
                predicates = ()
                break
            hops.append(hop)
            del rest[0]
        alias, view = fresh("n"), fresh("tq_within")
        self.within[alias] = Within(view, tuple(hops))
        rel = Rel((f"`{view}` {alias}",), (), Node(alias), (f"{alias}.doc", f"{alias}.pre"), bool(hops) and hops[-1].axis in REVERSE)
        return self.walk(self.predicates(rel, predicates, place), rest, place)

    def hop(self, step: A.Expr) -> Hop | None:
        """A step that needs a document's nodes only: tests of kinds and names, and fixed places."""
        if not isinstance(step, A.Step) or step.predicates and self.static.positional != "step":
            return None
        places = []
        for p in step.predicates:
            if isinstance(p, A.Literal) and isinstance(p.value, int) and p.value > 0:
                places.append(p.value)
            elif isinstance(p, A.Call) and _local(p.name) == "last" and not p.args:
                places.append(-1)
            else:
                return None
        test, principal = step.test, {"attribute": "attribute", "namespace": "namespace"}.get(step.axis, "element")
        if isinstance(test, A.NameTest):
            own = (self.static.default_namespace if principal == "element" else "") if test.local != "*" else None
            ns = own if test.prefix is None else None if test.prefix == "*" else self.static.namespace(test.prefix)
            return Hop(step.axis, principal, ns, None if test.local == "*" else test.local, tuple(places))
        if test.type is not None or test.inner is not None:
            return None
        prefix, colon, local = (test.name or "").rpartition(":")
        return Hop(step.axis, None if test.kind == "node" else _KINDS[test.kind], self.static.namespace(prefix) if colon else None, local or None, tuple(places))

    def inside(self, e: A.Expr, place: Place, what: str) -> Val | None:
        """The count or the values of a path from a node that is found in its document, as a column of that node's row."""
        if not self.within or not isinstance(e, A.Path) or e.absolute or not e.steps:
            return None
        start, *steps = self.fused(e.steps)
        if isinstance(start, A.Step):
            item, steps = place.item, [start, *steps]
        else:
            item = place.vars.get(start.name) if isinstance(start, A.Var) else place.item if isinstance(start, A.Context) else None
        hops = [self.hop(s) for s in steps]
        if not isinstance(item, Node) or item.alias not in self.within or not hops or any(h is None for h in hops):
            return None
        what = "typed" if what == "values" and self.static.typed else what
        sql = f"{item.alias}.{self.within[item.alias].member(what, tuple(hops))}"
        return integer(sql) if what == "count" else typed_items(sql) if what == "typed" else Val(sql, "untyped", seq=True, node=True)

    def branches(self, e: A.Expr) -> tuple[tuple[Hop, ...], ...] | None:
        """The hops of each branch of a union of relative paths; None where a document's nodes don't tell."""
        if isinstance(e, A.Binary) and e.op in ("union", "|"):
            left, right = self.branches(e.left), self.branches(e.right)
            return None if left is None or right is None else left + right
        if isinstance(e, A.Context):
            return ((),)
        steps = self.fused(e.steps) if isinstance(e, A.Path) and not e.absolute else [e]
        hops = [self.hop(s) for s in steps if not isinstance(s, A.Context)]
        return None if any(h is None for h in hops) else (tuple(hops),)  # type: ignore[arg-type]

    def fused(self, steps: tuple[A.Expr, ...]):
        """``descendant-or-self::node()/child::x`` is ``descendant::x`` where no predicate counts positions."""
        out: list[A.Expr] = []
        for step in steps:
            if (
                out and isinstance(step, A.Step) and step.axis == "child" and isinstance(out[-1], A.Step) and out[-1] == A.Step("descendant-or-self", A.KindTest("node"), ())
                and (self.static.positional == "step" or not any(self.positional(p) for p in step.predicates))
            ):
                out[-1] = A.Step("descendant", step.test, step.predicates)
            else:
                out.append(step)
        return out

    def is_table(self, step: A.Expr) -> bool:
        return isinstance(step, A.Step) and step.axis == "child" and not step.predicates and isinstance(step.test, A.NameTest) and step.test.prefix is None and step.test.local in self.static.tables

    def walk(self, rel: Rel | None, steps: list[A.Expr], place: Place) -> Rel | None:
        """The steps from ``rel``, or from the context node if that is None."""
        for step in steps:
            rel = self.step(rel, step, place)
        return rel

    def step(self, rel: Rel | None, step: A.Expr, place: Place) -> Rel:
        item = place.item if rel is None else rel.item
        if not isinstance(step, A.Step):
            inner = replace(place, item=item, where=False)
            if rel is None:
                found = self.relation(step, inner)
                if found is None:
                    raise XPathError("XPTY0019", "a step from a node must find nodes")
                return found
            rel, value = self.with_beside(rel, lambda: self.value(step, inner))
            return self.computed(rel, value)
        if isinstance(item, Row):
            value = self.column(item, step)
            if isinstance(value, Row):
                return rel
            found = self.computed(rel, value)
            return self.predicates(found, step.predicates, place)
        if isinstance(item, Val):
            if isinstance(step.test, A.KindTest) and step.test.kind in ("node", "text") and step.axis in ("child", "self") and item.node:
                return self.predicates(rel, step.predicates, place)
            raise XPathError("XPTY0020", "a step from an atomic value")
        if self.static.positional == "w3c" and any(self.positional(p) for p in step.predicates):
            return self.numbered_step(rel, step, place)
        return self.predicates(self.axis(rel, item, step), step.predicates, place)

    def computed(self, rel: Rel, value: Val) -> Rel:
        if not value.seq:
            return replace(rel.also(f"{value.sql} IS NOT NULL"), item=value)
        alias = fresh("e")
        return replace(rel, frm=(*rel.frm, f"LATERAL (SELECT posexplode({value.sql}) AS (i, v)) {alias}"), item=replace(value, sql=f"{alias}.v", seq=False), order=(*rel.order, f"{alias}.i"))

    def column(self, row: Row, step: A.Step) -> Val | Row:
        table = self.static.tables[row.table]
        if step.axis == "self":
            return row
        if step.axis not in ("child", "attribute", "descendant", "descendant-or-self"):
            raise XPathError("XPST0003", f"the {step.axis} axis leaves the row")
        if isinstance(step.test, A.NameTest) and step.test.local != "*":
            kind = table.columns.get(step.test.local)
            if kind is None:
                return EMPTY
            return Val(f"{row.alias}.`{step.test.local}`", kind, node=True)
        return replace(sequences.together([Val(f"{row.alias}.`{c}`", t, node=True) for c, t in table.columns.items()]), node=True)

    # Nodes.

    def node_rel(self, condition: str, more: tuple[str, ...] = ()) -> Rel:
        alias = fresh("n")
        conditions = tuple(c.replace("{n}", alias) for c in (condition, *more))
        return Rel((f"`{self.static.nodes}` {alias}",), conditions, Node(alias), (f"{alias}.doc", f"{alias}.pre"))

    def node_test(self, test: A.NameTest | A.KindTest, axis: str) -> str:
        principal = {"attribute": "attribute", "namespace": "namespace"}.get(axis, "element")
        if isinstance(test, A.NameTest):
            out = [f"{{n}}.kind = '{principal}'"]
            if test.local != "*":
                out.append(f"{{n}}.local = {text_literal(test.local)}")
            if test.prefix is None:
                if test.local != "*":
                    out.append(f"{{n}}.ns = {text_literal(self.static.default_namespace if principal == 'element' else '')}")
            elif test.prefix != "*":
                out.append(f"{{n}}.ns = {text_literal(self.static.namespace(test.prefix))}")
            return " AND ".join(out)
        if test.kind == "node":
            return "true"
        out = [f"{{n}}.kind = '{_KINDS[test.kind]}'"]
        if test.name is not None:
            prefix, colon, local = test.name.rpartition(":")
            out.append(f"{{n}}.local = {text_literal(local)}")
            if colon:
                out.append(f"{{n}}.ns = {text_literal(self.static.namespace(prefix))}")
        if test.type is not None:
            name = test.type.rpartition(":")[2]
            if name not in ("anyType", "untyped", "anySimpleType", "untypedAtomic", "anyAtomicType"):
                out.append(f"array_contains({{n}}.types, {text_literal(name)})")
        if test.inner is not None:
            inner = self.node_test(test.inner, "child").replace("{n}", "k")
            out.append(f"EXISTS (SELECT 1 FROM `{self.static.nodes}` k WHERE k.doc = {{n}}.doc AND k.parent = {{n}}.pre AND {inner})")
        return " AND ".join(out)

    def between(self, axis: str, a: str, n: str) -> str:
        """Is node ``n`` on the axis of node ``a``? Attributes and namespaces lie inside their owner's interval, but on none of the tree's axes."""
        tree = f"{n}.kind NOT IN ('attribute', 'namespace')"
        return f"{n}.doc = {a}.doc AND " + {
            "child": f"{n}.parent = {a}.pre AND {tree}",
            "descendant": f"{n}.pre > {a}.pre AND {n}.pre <= {a}.post AND {tree}",
            "descendant-or-self": f"{n}.pre >= {a}.pre AND {n}.pre <= {a}.post AND ({tree} OR {n}.pre = {a}.pre)",
            "attribute": f"{n}.parent = {a}.pre AND {n}.kind = 'attribute'",
            "namespace": f"{n}.parent = {a}.pre AND {n}.kind = 'namespace'",
            "self": f"{n}.pre = {a}.pre",
            "parent": f"{n}.pre = {a}.parent",
            "ancestor": f"{n}.pre < {a}.pre AND {n}.post >= {a}.post AND {tree}",
            "ancestor-or-self": f"{n}.pre <= {a}.pre AND {n}.post >= {a}.post AND ({tree} OR {n}.pre = {a}.pre)",
            "following-sibling": f"{n}.parent = {a}.parent AND {n}.pre > {a}.pre AND {tree} AND {a}.kind NOT IN ('attribute', 'namespace')",
            "preceding-sibling": f"{n}.parent = {a}.parent AND {n}.pre < {a}.pre AND {tree} AND {a}.kind NOT IN ('attribute', 'namespace')",
            "following": f"{n}.pre > {a}.post AND {tree}",
            "preceding": f"{n}.post < {a}.pre AND {tree}",
        }[axis]

    def axis(self, rel: Rel | None, item: Item, step: A.Step) -> Rel:
        """Nodes that some context node reaches: a semi join, so a node is found once however often it is reached."""
        assert isinstance(item, Node)
        found = self.node_rel(self.node_test(step.test, step.axis))
        near = self.between(step.axis, item.alias, found.item.alias)  # type: ignore[union-attr]
        if rel is None:
            found = found.also(near)
        elif step.axis in ("child", "attribute", "namespace", "self"):
            # A child has one parent: an inner join finds it once as well.
            found = replace(found, frm=(*rel.frm, *found.frm), where=(*rel.where, *found.where, near))
        else:
            found = found.also(f"EXISTS ({rel.also(near).sql('1')})")
        return replace(found, reverse=step.axis in REVERSE)

    def numbered_step(self, rel: Rel | None, step: A.Step, place: Place) -> Rel:
        """A step whose positions start anew for each context node."""
        item = place.item if rel is None else rel.item
        alias = fresh("n")
        test = self.node_test(step.test, step.axis).replace("{n}", alias)
        near = self.between(step.axis, item.alias, alias)
        base = Rel((*(rel.frm if rel else ()), f"`{self.static.nodes}` {alias}"), (*(rel.where if rel else ()), test, near), Node(alias), (f"{alias}.doc", f"{alias}.pre"), step.axis in REVERSE)
        group = f"PARTITION BY {item.alias}.doc, {item.alias}.pre" if rel else f"PARTITION BY {alias}.doc"
        for p in step.predicates:
            base = self.numbered(base, p, place, group, keep=f"{item.alias}.doc AS cdoc, {item.alias}.pre AS cpre")
            group = f"PARTITION BY {alias}.cdoc, {alias}.cpre"
            item = Node(alias)
        # A node that several context nodes select is found once.
        out = fresh("n")
        met = f"{alias}.doc = {out}.doc AND {alias}.pre = {out}.pre"
        return Rel((f"`{self.static.nodes}` {out}",), (f"EXISTS ({base.also(met).sql('1')})",), Node(out), (f"{out}.doc", f"{out}.pre"), step.axis in REVERSE)

    def by_id(self, e: A.Call, place: Place) -> Rel:
        wanted = self.value(e.args[0], replace(place, where=False))
        name = fresh()
        ids = f"flatten(transform({items_of(wanted)}, {name} -> split({lexical.normalized(name, 'collapse')}, ' ')))"
        same = (f"{{n}}.doc = {place.item.alias}.doc",) if isinstance(place.item, Node) else ()
        return self.node_rel("{n}.kind = 'element'", (f"array_contains({ids}, {{n}}.xml_id)", *same))

    # Predicates.

    def positional(self, p: A.Expr) -> bool:
        if isinstance(p, A.Literal):
            return p.type != "string"
        if _uses_position(p):
            return True
        return isinstance(p, A.Binary) and p.op in ("+", "-", "*", "div", "idiv", "mod") or isinstance(p, A.Unary) or isinstance(p, A.Call) and _local(p.name) in ("count", "sum", "string-length", "number", "round", "floor", "ceiling", "abs", "max", "min")

    def predicates(self, rel: Rel, predicates: tuple[A.Expr, ...], place: Place) -> Rel:
        for p in predicates:
            if self.positional(p):
                rel = self.at_position(rel, p, place)
                continue
            inner = replace(place, item=rel.item, where=True)
            wider, value = self.with_beside(rel, lambda p=p, inner=inner: self.value(p, inner))  # type: ignore[misc]
            if value.type in NUMERIC and not value.node:
                rel = self.at_position(rel, p, place)
            else:
                rel = wider.also(truth(value))
        return rel

    def at_position(self, rel: Rel, p: A.Expr, place: Place) -> Rel:
        """A predicate on positions. The first and the last k are a sorted limit; only other tests number all rows."""
        if not rel.order:
            raise XPathError("XPDY0002", "positions need a table with a document order")
        bound = self.bound(p)
        if isinstance(rel.item, Row) and bound is not None:
            alias = rel.item.alias
            low, high = bound
            if high is None:
                order = ", ".join(f"{o} DESC" for o in rel.order)
                limit = " LIMIT 1"
            else:
                order, limit = ", ".join(rel.order), f" LIMIT {max(0, high - low + 1)}" + (f" OFFSET {low - 1}" if low > 1 else "")
            return replace(rel, frm=(f"({rel.sql(f'{alias}.*', f' ORDER BY {order}{limit}')}) {alias}",), where=(), order=tuple(f"{alias}.{o.rpartition('.')[2]}" for o in rel.order))
        group = f"PARTITION BY {rel.order[0]}" if isinstance(rel.item, Node) else ""
        return self.numbered(rel, p, place, group)

    def bound(self, p: A.Expr) -> tuple[int, int | None] | None:
        """(first, last) place that a predicate selects; last None: the last item."""
        if isinstance(p, A.Literal) and isinstance(p.value, int):
            return (p.value, p.value) if p.value > 0 else (1, 0)
        if isinstance(p, A.Call) and _local(p.name) == "last":
            return (1, None)
        if isinstance(p, A.Binary) and isinstance(p.left, A.Call) and _local(p.left.name) == "position" and isinstance(p.right, A.Literal) and isinstance(p.right.value, int):
            n = p.right.value
            return {"<=": (1, n), "le": (1, n), "<": (1, n - 1), "lt": (1, n - 1), "=": (n, n), "eq": (n, n)}.get(p.op)
        return None

    def numbered(self, rel: Rel, p: A.Expr, place: Place, group: str, keep: str = "") -> Rel:
        item = rel.item
        alias = item.alias if isinstance(item, Row | Node) else fresh("p")
        order = ", ".join(f"{o} DESC" if rel.reverse else o for o in rel.order)
        if isinstance(item, Val):
            select = f"{item.sql} AS v" + "".join(f", {o} AS o{i}" for i, o in enumerate(rel.order))
            kept_order, new = tuple(f"{alias}.o{i}" for i in range(len(rel.order))), replace(item, sql=f"{alias}.v")
        else:
            select = f"{alias}.*"
            kept_order, new = tuple(f"{alias}.{o.rpartition('.')[2]}" for o in rel.order), item
            if "_pos," in rel.frm[-1]:
                select = f"{alias}.* EXCEPT (_pos, _last)"
                keep = "" if "cdoc" in rel.frm[-1] else keep
        counts = any(isinstance(x, A.Call) and _local(x.name) == "last" for x in A.walk(p))
        bounds = self.static.tables[item.table].bounds if isinstance(item, Row) and not rel.reverse and place.item is None else None
        if bounds is not None and (cuts := bounds()):
            out = self.numbered_by_stretch(rel, alias, select, order, cuts)
            return self.where_position(replace(out, order=kept_order), p, place)
        last = f"count(1) OVER ({group})" if counts else "cast(null as bigint)"
        select += (f", {keep}" if keep else "") + f", row_number() OVER ({group} ORDER BY {order}) AS _pos, {last} AS _last"
        return self.where_position(Rel((f"({rel.sql(select)}) {alias}",), (), new, kept_order, rel.reverse), p, place)

    def numbered_by_stretch(self, rel: Rel, alias: str, select: str, order: str, cuts: list[str]) -> Rel:
        """Rows numbered in each stretch of the order column, and shifted by the rows of the stretches before: no task sees all rows."""
        key = rel.order[0]
        stretch = f"size(filter(array({', '.join(cuts)}), c -> c < {key}))"
        base, shifts = fresh("b"), fresh("s")
        rows = rel.sql(f"{select}, {stretch} AS _stretch")
        counts = f"SELECT _stretch AS _s, count(1) AS _n FROM ({rel.sql(f'{stretch} AS _stretch')}) GROUP BY _stretch"
        sums = f"SELECT _s, coalesce(sum(_n) OVER (ORDER BY _s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before, sum(_n) OVER () AS _last FROM ({counts})"
        ranked = order.replace(f"{alias}.", f"{base}.")
        number = f"row_number() OVER (PARTITION BY {base}._stretch ORDER BY {ranked}) + {shifts}._before AS _pos, {shifts}._last AS _last"
        sql = f"SELECT {base}.* EXCEPT (_stretch), {number} FROM ({rows}) {base} JOIN ({sums}) {shifts} ON {base}._stretch = {shifts}._s"
        return Rel((f"({sql}) {alias}",), (), rel.item)

    def where_position(self, out: Rel, p: A.Expr, place: Place) -> Rel:
        """The rows of a numbered relation, which has _pos and _last, that a predicate selects."""
        new = out.item
        alias = new.alias if isinstance(new, Row | Node) else new.sql.partition(".")[0]
        position, total = integer(f"cast({alias}._pos as bigint)"), integer(f"{alias}._last")
        out, value = self.with_beside(out, lambda: self.value(p, replace(place, item=new, position=position, last=total, where=True)))
        if value.type in NUMERIC and not value.node:
            return out.also(f"{alias}._pos = {value.sql}")
        return out.also(truth(value))

    # Operations on relations.

    def key(self, item: Item) -> list[str]:
        if isinstance(item, Node):
            return [f"{item.alias}.doc", f"{item.alias}.pre"]
        if isinstance(item, Row):
            order = self.static.tables[item.table].order
            if not order:
                raise XPathError("XPDY0002", "set operations need a table with a key")
            return [f"{item.alias}.`{c}`" for c in order]
        raise XPathError("XPTY0004", "set operations need nodes")

    def set_operation(self, e: A.Binary, place: Place) -> Rel | None:
        left, right = self.relation(e.left, place), self.relation(e.right, place)
        if left is None or right is None:
            if isinstance(place.item, Row) and e.op in ("union", "|"):
                return None
            raise XPathError("XPTY0004", "set operations need nodes")
        column = isinstance(left.item, Val) and isinstance(right.item, Val) and left.item.node and right.item.node
        a, b = self.base(left), self.base(right)
        if type(a) is not type(b) or isinstance(a, Row) and a.table != b.table:  # type: ignore[union-attr]
            if e.op == "except":
                return left
            raise XPathError("XPTY0004", "nodes of different documents")
        if column and left.item.sql.rpartition(".")[2] != right.item.sql.rpartition(".")[2]:  # type: ignore[union-attr]
            raise XPathError("XPTY0004", "set operations over different columns")
        alias = fresh("u")
        same = " AND ".join(f"{x} <=> {alias}.{x.rpartition('.')[2]}" for x in self.key(a))
        met = " AND ".join(f"{x} <=> {alias}.{y.rpartition('.')[2]}" for x, y in zip(self.key(b), self.key(a), strict=True))
        view = self.static.nodes if isinstance(a, Node) else self.static.tables[a.table].view  # type: ignore[union-attr]
        tests = [f"EXISTS ({left.also(same).sql('1')})", f"EXISTS ({right.also(met).sql('1')})"]
        word = {"intersect": " AND ", "except": " AND NOT "}.get(e.op, " OR ")
        item: Item = Node(alias) if isinstance(a, Node) else Row(alias, a.table)  # type: ignore[union-attr]
        order = tuple(f"{alias}.{k.rpartition('.')[2]}" for k in self.key(a))
        out = Rel((f"`{view}` {alias}",), (f"({word.join(tests)})",), item, order)
        if column:
            value = left.item
            out = replace(out, item=replace(value, sql=f"{alias}.{value.sql.rpartition('.')[2]}"))  # type: ignore[union-attr, type-var]
        return out

    def base(self, rel: Rel) -> Item:
        """The row or node that a relation's item lies in."""
        if not isinstance(rel.item, Val):
            return rel.item
        alias = rel.item.sql.partition(".")[0]
        name = next((t for t, x in self.static.tables.items() if any(f"`{x.view}` {alias}" in f for f in rel.frm)), None)
        if name is None:
            raise XPathError("XPTY0004", "set operations need nodes")
        return Row(alias, name)

    def atom(self, rel: Rel) -> Val:
        return self.atomized(rel.item)

    def atomized(self, item: Item) -> Val:
        if isinstance(item, Val):
            return item
        if isinstance(item, Node):
            numeric = f"coalesce(arrays_overlap({item.alias}.types, array('decimal', 'float', 'double')), false)" if self.static.typed else None
            return Val(f"{item.alias}.value", "untyped", node=True, numeric=numeric)
        columns = self.static.tables[item.table].columns
        return Val(f"concat({', '.join(f'coalesce({as_text(Val(f'{item.alias}.`{c}`', t))}, {chr(39) * 2})' for c, t in columns.items())})", "untyped", node=True)

    def concatenation(self, e: A.Sequence, place: Place) -> Rel:
        """Relations one after another, told apart by their ordinal."""
        parts = [self.relation(x, place) or Rel(("(SELECT 1)",), (), self.value(x, place)) for x in e.items]
        values = [self.atom(p) for p in parts]
        kind = sequences.together([replace(v, seq=False) for v in values]).type
        alias, width = fresh("c"), max(len(p.order) for p in parts)
        sqls = []
        for i, (p, v) in enumerate(zip(parts, values, strict=True)):
            if v.seq:
                p, v = (q := self.computed(p, v)), q.item  # noqa: PLW2901
            v = v if v.type == kind else cast(v, kind)  # noqa: PLW2901
            keys = [f"cast({o} as string) AS k{j}" if len(parts) > 1 else f"{o} AS k{j}" for j, o in enumerate(p.order)] + [f"null AS k{j}" for j in range(len(p.order), width)]
            sqls.append(p.sql(f"{v.sql} AS v, {i} AS part" + "".join(f", {k}" for k in keys)))
        return Rel((f"({' UNION ALL '.join(sqls)}) {alias}",), (f"{alias}.v IS NOT NULL",), Val(f"{alias}.v", kind), (f"{alias}.part", *(f"{alias}.k{j}" for j in range(width))))

    def pass_through(self, name: str, rel: Rel, rest: tuple[A.Expr, ...], place: Place) -> Rel:
        if name in ("unordered", "trace", "zero-or-one", "one-or-more", "exactly-one"):
            return rel
        if name == "data":
            return replace(rel, item=replace(self.atom(rel), node=False))
        if name == "reverse":
            return replace(rel, reverse=not rel.reverse)
        if name == "distinct-values":
            value, alias = self.atom(rel), fresh("d")
            return Rel((f"({rel.also(f'{value.sql} IS NOT NULL').sql(f'DISTINCT {value.sql} AS v')}) {alias}",), (), replace(value, sql=f"{alias}.v", node=False), (f"{alias}.v",))
        position = A.Call("position", ())
        start = A.Call("round", (rest[0],))
        test: A.Expr = A.Binary(">=", position, start)
        if len(rest) == 2:
            if all(isinstance(x, A.Literal) and isinstance(x.value, int) for x in rest):
                first, length = rest[0].value, rest[1].value  # type: ignore[attr-defined]
                if first == 1:
                    return self.at_position(rel, A.Binary("<=", position, A.Literal(length, "integer")), place)
            test = A.Binary("and", test, A.Binary("<", position, A.Binary("+", start, A.Call("round", (rest[1],)))))
        return self.at_position(rel, test, place)

    def loop(self, e: A.For, place: Place) -> Rel | None:
        """Nested loops are joins: what a later binding tests of an earlier variable is the join's condition."""
        frm: list[str] = []
        where: list[str] = []
        order: list[str] = []
        inner = replace(place, where=False)
        seen = False
        grouped = self.grouping(e, place)
        if grouped is not None:
            return grouped
        for name, source in e.bindings:
            rel = self.relation(source, inner)
            if rel is None:
                value = self.value(source, inner)
                alias = fresh("f")
                rel = Rel((f"LATERAL (SELECT posexplode({items_of(value)}) AS (i, v)) {alias}",), (), replace(value, sql=f"{alias}.v", seq=False), (f"{alias}.i",))
                if not frm:
                    rel = replace(rel, frm=("(SELECT 1)", *rel.frm))
            else:
                seen = True
            frm += rel.frm
            where += rel.where
            order += rel.order
            inner = inner.bind(name, rel.item)
        if not seen:
            return None
        rel = Rel(tuple(frm), tuple(where), EMPTY, tuple(order))
        if isinstance(e.body, A.Sequence) and len(e.body.items) > 1:
            rel, members = self.with_beside(rel, lambda: tuple(one(self.value(x, inner)) for x in e.body.items))  # type: ignore[assignment]
            out = self.computed(rel, sequences.together(list(members)))  # type: ignore[arg-type]
            return replace(out, members=members)
        body = self.relation(e.body, inner)
        if body is not None:
            return replace(body, frm=(*rel.frm, *body.frm), where=(*rel.where, *body.where), order=(*rel.order, *body.order))
        if isinstance(e.body, A.Var) and isinstance(inner.vars.get(e.body.name), Row | Node):
            return replace(rel, item=inner.vars[e.body.name])
        rel, value = self.with_beside(rel, lambda: self.value(e.body, inner))
        return self.computed(rel, value)

    def grouping(self, e: A.For, place: Place) -> Rel | None:
        """``for $k in distinct-values(P/c) return f(agg(P[c = $k]/x))`` is one GROUP BY, if all paths of the body are such."""
        if len(e.bindings) != 1:
            return None
        name, source = e.bindings[0]
        if not (isinstance(source, A.Call) and _local(source.name) == "distinct-values" and len(source.args) == 1 and isinstance(source.args[0], A.Path)):
            return None
        path = source.args[0]
        if not (path.absolute and len(path.steps) == 3 and self.is_table(path.steps[0]) and all(isinstance(s, A.Step) for s in path.steps) and not path.steps[2].predicates):  # type: ignore[attr-defined]
            return None
        head, key = path.steps[1], path.steps[2]
        column = A.Path(False, (key,))
        tests = {A.Binary(sign, *pair) for sign in ("=", "eq") for pair in ((column, A.Var(name)), (A.Var(name), column))}

        def member(p: A.Expr) -> bool:
            return (
                isinstance(p, A.Path) and p.absolute and len(p.steps) >= 2 and p.steps[0] == path.steps[0] and isinstance(p.steps[1], A.Step) and p.steps[1].test == head.test
                and len(p.steps[1].predicates) >= 1 and p.steps[1].predicates[-1] in tests and p.steps[1].predicates[:-1] == head.predicates
            )

        paths = [x for x in A.walk(e.body) if isinstance(x, A.Path) and x.absolute]
        calls = [x for x in A.walk(e.body) if isinstance(x, A.Call) and _local(x.name) in ("count", "sum", "avg", "min", "max") and len(x.args) == 1 and isinstance(x.args[0], A.Path) and member(x.args[0])]
        if not paths or len(calls) != len(paths) or any(self.positional(p) for p in head.predicates):
            return None
        rel = self.predicates(self.table(path.steps[0].test.local), head.predicates, place)  # type: ignore[union-attr]
        row = rel.item
        group = self.column(row, key)  # type: ignore[arg-type]
        alias, select, known = fresh("g"), [f"{group.sql} AS k"], {}
        for call in calls:
            if call in known:
                continue
            inner = self.walk(Rel(("x",), (), row), list(call.args[0].steps[2:]), place)  # type: ignore[attr-defined]
            value = self.aggregate(_local(call.name), self.atom(inner), " AND ".join(inner.where))
            known[call] = replace(value, sql=f"{alias}.a{len(known)}")
            select.append(f"{value.sql} AS a{len(known) - 1}")
        out = Rel((f"({rel.also(f'{group.sql} IS NOT NULL').sql(', '.join(select), f' GROUP BY {group.sql}')}) {alias}",), (), EMPTY, (f"{alias}.k",))
        inner_place = replace(place.bind(name, replace(group, sql=f"{alias}.k", node=False)), where=False)
        outer, self.known = getattr(self, "known", {}), known
        try:
            if isinstance(e.body, A.Sequence) and len(e.body.items) > 1:
                members = tuple(one(self.value(x, inner_place)) for x in e.body.items)
                return replace(self.computed(out, sequences.together(list(members))), members=members)
            return self.computed(out, self.value(e.body, inner_place))
        finally:
            self.known = outer

    def aggregate(self, name: str, value: Val, where: str = "") -> Val:
        """A SQL aggregate of a value over rows, of those where ``where`` holds."""
        only = f" FILTER (WHERE {where})" if where else ""
        if name == "count":
            return integer(f"count(1){only}")
        if name in ("sum", "avg"):
            value = cast(value, "double") if value.type == "untyped" else value
            if value.type not in (*NUMERIC, "yearMonth", "dayTime"):
                raise XPathError("FORG0006", f"no {name} of {value.type}")
            kind = "decimal" if value.type == "integer" else value.type
            total = f"sum({value.sql}){only}"
            if name == "sum":
                return Val(f"coalesce(cast({total} as {SQL_OF[kind]}), cast(0 as {SQL_OF[kind]}))", kind)
            if kind in ("float", "double"):
                return Val(f"cast(avg({value.sql}){only} as {SQL_OF[kind]})", kind)
            mean = arithmetic("div", Val(f"cast({total} as {SQL_OF[kind]})", kind), integer(f"count({value.sql}){only}"))
            return replace(mean, sql=f"if(count({value.sql}){only} = 0, null, {mean.sql})")
        value = cast(value, "double") if value.type == "untyped" else value
        if value.type in ("date", "dateTime", "time", "boolean"):
            raise XPathError("FORG0006", f"no {name} of {value.type}")
        out = f"{name}({value.sql}){only}"
        if name == "min" and value.type in ("float", "double"):
            out = f"if(isnan(max({value.sql}){only}), cast('NaN' as {value.type}), {out})"
        return Val(out, value.type)

    # Expressions in a row.

    def value(self, e: A.Expr, place: Place) -> Val:
        known = getattr(self, "known", {}).get(e) if isinstance(e, A.Call) else None
        if known is not None:
            return known
        name = type(e).__name__
        return getattr(self, f"v_{name}")(e, place)

    def v_Literal(self, e: A.Literal, place: Place) -> Val:
        return of_literal(e.value, e.type)

    def v_Var(self, e: A.Var, place: Place) -> Val:
        item = place.vars.get(e.name, self.static.variables.get(e.name))
        if item is None:
            raise XPathError("XPST0008", f"unknown variable ${e.name}")
        return self.atomized(item)

    def v_Context(self, e: A.Context, place: Place) -> Val:
        if place.item is None:
            raise XPathError("XPDY0002", "there is no context item")
        return self.atomized(place.item)

    def v_Sequence(self, e: A.Sequence, place: Place) -> Val:
        return sequences.together([self.value(x, place) for x in e.items])

    def v_If(self, e: A.If, place: Place) -> Val:
        test = ebv(self.value(e.test, place))
        a, b = self.value(e.then, place), self.value(e.other, place)
        if a.type == "empty" and b.type == "empty":
            return EMPTY
        if a.seq or b.seq:
            kind = sequences.together([a, b]).type
            x, y = (items_of(v if v.type == kind else sequences.together([v, Val("null", kind)]) if v.type == "empty" else sequences.cast_items(v, kind)) for v in (a, b))
            return Val(f"if({test}, {x}, {y})", kind, seq=True)
        if a.type == "empty":
            return replace(b, sql=f"if({test}, null, {b.sql})", const=None, node=False)
        if b.type == "empty":
            return replace(a, sql=f"if({test}, {a.sql}, null)", const=None, node=False)
        kind = sequences.together([a, b]).type
        a, b = (v if v.type == kind else cast(v, kind) for v in (a, b))
        tz = f"if({test}, {a.tz or 'null'}, {b.tz or 'null'})" if a.tz or b.tz else None
        return Val(f"if({test}, {a.sql}, {b.sql})", kind, tz=tz)

    def v_For(self, e: A.For, place: Place) -> Val:
        rel = self.relation(e, place)
        if rel is not None:
            return self.gathered(rel)
        name, source = e.bindings[0]
        rest = A.For(e.bindings[1:], e.body) if len(e.bindings) > 1 else e.body
        value, x = self.value(source, place), fresh()
        if value.type == "empty":
            return EMPTY
        body = self.value(rest, replace(place.bind(name, replace(value, sql=x, seq=False, node=False)), where=False))
        inner = f"transform({items_of(value)}, {x} -> {items_of(body)})"
        return replace(body, sql=f"flatten({inner})", seq=True, node=False, const=None)

    def v_Quantified(self, e: A.Quantified, place: Place) -> Val:
        inner, frm, where, wraps, exists_ = replace(place, where=True), [], [], [], False
        for name, source in e.bindings:
            rel = self.relation(source, replace(inner, where=False))
            if rel is None:
                value, x = self.value(source, inner), fresh()
                wraps.append((items_of(value), x))
                inner = inner.bind(name, replace(value, sql=x, seq=False, node=False))
                continue
            exists_ = True
            frm += rel.frm
            where += rel.where
            inner = inner.bind(name, rel.item)
        if exists_ and wraps:
            raise XPathError("XPST0003", "a quantifier binds paths or sequences, not both")
        if exists_:
            if e.every and place.where and (found := self.never_equal(Rel(tuple(frm), tuple(where), EMPTY), e.test, inner)):
                return boolean(found)
            rel, value = self.with_beside(Rel(tuple(frm), tuple(where), EMPTY), lambda: self.value(e.test, inner))
            found = self.any(rel.also(f"NOT ({ebv(value)})" if e.every else truth(value)), place)
            return boolean(f"(NOT {found})" if e.every else found)
        test = ebv(self.value(e.test, replace(inner, where=False)))
        for items, x in reversed(wraps):
            test = f"coalesce({'forall' if e.every else 'exists'}({items}, {x} -> {test}), {'true' if e.every else 'false'})"
        return boolean(test)

    def never_equal(self, rel: Rel, test: A.Expr, place: Place) -> str | None:
        """SQL of ``every … satisfies a != b`` as tests that join by equality: no pair is equal, and no row lacks a side. None for other tests."""
        if not (isinstance(test, A.Binary) and test.op == "!=" and self.static.mode == "2.0") or any(self.relation(x, place) is not None for x in (test.left, test.right)):
            return None
        rel, sides = self.with_beside(rel, lambda: [self.value(x, place) for x in (test.left, test.right)])  # type: ignore[arg-type, return-value]
        if any(v.seq or v.numeric or v.type == "empty" for v in sides):  # type: ignore[attr-defined]
            return None
        found = unequal(*sides)  # type: ignore[misc]
        if found is None:
            return None
        equal, values = found
        own = [f.rpartition(" ")[2] for f in rel.frm]
        tests = [f"NOT EXISTS ({rel.also(equal).sql('1')})"]
        for v in values:
            if any(re.search(rf"\b{alias}\.", v) for alias in own):
                tests.append(f"NOT EXISTS ({rel.also(f'{v} IS NULL').sql('1')})")
            else:
                tests.append(f"NOT ({v} IS NULL AND EXISTS ({rel.sql('1')}))")
        return f"({' AND '.join(tests)})"

    def any(self, rel: Rel, place: Place) -> str:
        """SQL: does the relation have a row?"""
        return f"EXISTS ({rel.sql('1')})" if place.where else f"(coalesce(({rel.sql('count(1)')}), 0) > 0)"

    def v_Unary(self, e: A.Unary, place: Place) -> Val:
        v = self.value(e.operand, place)
        if self.static.mode == "1.0":
            v = Val(sequences.to_number(v).sql, "double")
        return negative(v) if e.op == "-" else sequences._numeric(v)

    def v_Binary(self, e: A.Binary, place: Place) -> Val:
        if e.op in ("and", "or"):
            left, right = (self.value(x, place) for x in (e.left, e.right))
            a, b = ebv(left), ebv(right)
            # The left side guards the right one's errors.
            if "raise_error" in b:
                return boolean(f"(case when {a} then {b} else false end)" if e.op == "and" else f"(case when {a} then true else {b} end)")
            return Val(f"({a} {e.op} {b})", "boolean", bare=f"({truth(left)} {e.op} {truth(right)})")
        if e.op in ("union", "|", "intersect", "except"):
            rel = self.relation(e, place)
            if rel is not None:
                return self.gathered(rel)
            return sequences.together([self.value(e.left, place), self.value(e.right, place)])
        if e.op in ("is", "<<", ">>"):
            return self.node_compare(e, place)
        if e.op in GENERAL:
            return self.general(e, place)
        a, b = self.value(e.left, place), self.value(e.right, place)
        if e.op in ("eq", "ne", "lt", "le", "gt", "ge"):
            return value_compare(e.op, a, b)
        if e.op == "to":
            low, high = cast(a, "integer"), cast(b, "integer")
            return Val(f"case when {low.sql} <= {high.sql} then sequence({low.sql}, {high.sql}, 1L) else cast(array() as array<bigint>) end", "integer", seq=True)
        if self.static.mode == "1.0":
            a, b = (Val(sequences.to_number(v).sql, "double") for v in (a, b))
        return arithmetic(e.op, a, b)

    def general(self, e: A.Binary, place: Place) -> Val:
        op = GENERAL[e.op]
        left, right = self.relation(e.left, place), self.relation(e.right, place)
        if left is None and right is None:
            a, b = self.value(e.left, place), self.value(e.right, place)
            if self.static.mode == "1.0":
                if "boolean" in (a.type, b.type):
                    a, b = boolean(ebv(a)), boolean(ebv(b))
                elif e.op not in ("=", "!=") or a.type in NUMERIC or b.type in NUMERIC:
                    a, b = (Val(sequences.to_number(v).sql, "double") if not v.seq else v for v in (a, b))
            return general_compare(op, a, b)
        if self.within and all(r is None or self.inside(x, place, "values") is not None for r, x in ((left, e.left), (right, e.right))):
            sides = [self.value(x, replace(place, where=False)) for x in (e.left, e.right)]
            return general_compare(op, *sides)
        rels = [r for r in (left, right) if r is not None]
        a = self.atom(left) if left is not None else self.value(e.left, replace(place, where=False))
        b = self.atom(right) if right is not None else self.value(e.right, replace(place, where=False))
        pair = truth(general_compare(op, a, b))
        return boolean(self.any(Rel(tuple(f for r in rels for f in r.frm), (*(w for r in rels for w in r.where), pair), EMPTY), place))

    def node_compare(self, e: A.Binary, place: Place) -> Val:
        sides = [self.node(x, place) for x in (e.left, e.right)]
        if any(s is None for s in sides):
            return Val("cast(null as boolean)", "boolean")
        a, b = sides
        sign = {"is": "=", "<<": "<", ">>": ">"}[e.op]
        found = f"(struct({a('doc')}, {a('pre')}) {sign} struct({b('doc')}, {b('pre')}))"
        return boolean(f"if({a('pre')} is null or {b('pre')} is null, null, {found})")

    def node(self, e: A.Expr, place: Place):
        """A function from a node column to its SQL for the single node that ``e`` gives, or None for nothing."""
        item = place.vars.get(e.name) if isinstance(e, A.Var) else place.item if isinstance(e, A.Context) else None
        if isinstance(item, Node):
            return lambda c: f"{item.alias}.{c}"
        if isinstance(e, A.Sequence) and not e.items:
            return None
        rel = self.relation(e, place)
        if rel is None or not isinstance(rel.item, Node):
            raise XPathError("XPTY0004", "a node is wanted")
        n = rel.item.alias
        return lambda c: f"({rel.sql(f'min_by({n}.{c}, {n}.pre)')})"

    def v_TypeTest(self, e: A.TypeTest, place: Place) -> Val:
        v = self.value(e.operand, place)
        if e.op in ("cast", "castable"):
            target = self.atomic(e.type.item)
            if e.op == "castable":
                out = castable(one(v), target) if v.type != "empty" else boolean("false")
                return boolean(f"({out.sql} or {one(v).sql} is null)") if e.type.occurrence == "?" else out
            return cast(self.in_range(one(v), str(e.type.item)), target)
        test = self.instance(v, e.type)
        if e.op == "instance":
            return boolean(test)
        return replace(v, sql=f"case when {test} then {v.sql} else {error('XPTY0004', 'treat as another type')} end", const=None)

    def atomic(self, name: object) -> str:
        prefix, _, local = str(name).rpartition(":")
        if prefix and self.static.namespace(prefix) != self.static.namespaces["xs"] or local not in lexical.TYPES or local in ("anySimpleType", "anyAtomicType", "NOTATION"):
            raise XPathError("XPST0051", f"no built-in atomic type {name}")
        if lexical.derives(local, "integer"):
            return "integer"
        if lexical.derives(local, "string"):
            return "string"
        return OF_XS.get(local, local)

    def in_range(self, v: Val, name: str) -> Val:
        """Checks the bounds and lexical space of a derived target type."""
        local = name.rpartition(":")[2]
        kind = lexical.TYPES.get(local)
        if kind is None or local in ("integer", "string") or not (lexical.derives(local, "integer") or lexical.derives(local, "string")):
            return v
        text = as_text(v if v.type not in ("decimal", "float", "double", "boolean") else cast(v, "integer"))
        if lexical.derives(local, "string"):
            return string(f"case when {text} is null or {lexical.valid(text, local)} then {lexical.normalized(text, kind.space)} else {error('FORG0001', 'no xs:' + local)} end")
        return Val(f"case when {text} is null or {lexical.valid(text, local)} then {text} else {error('FORG0001', 'no xs:' + local)} end", "string")

    def instance(self, v: Val, kind: A.SequenceType) -> str:
        count = sequences.size(v)
        if kind.item == "empty-sequence()":
            return f"({count} = 0)"
        sizes = {"": f"{count} = 1", "?": f"{count} <= 1", "+": f"{count} >= 1", "*": "true"}[kind.occurrence]
        if isinstance(kind.item, A.KindTest):
            fits = v.node
        elif kind.item == "item()":
            fits = True
        else:
            local = str(kind.item).rpartition(":")[2]
            own = {"untyped": "untypedAtomic", "yearMonth": "yearMonthDuration", "dayTime": "dayTimeDuration"}.get(v.type, v.type)
            fits = not v.node and (own == local or local == "anyAtomicType" or lexical.derives(own, local))
        if fits or v.type == "empty":
            return f"({sizes})"
        return f"({count} = 0)" if kind.occurrence in ("?", "*") else "false"

    def v_Filter(self, e: A.Filter, place: Place) -> Val:
        rel = self.relation(e, place)
        if rel is not None:
            return self.gathered(rel)
        v = self.value(e.primary, place)
        for p in e.predicates:
            if v.type == "empty":
                return v
            whole, x, i = fresh("a"), fresh(), fresh("i")
            item = replace(v, sql=x, seq=False, const=None)
            inner = replace(place, item=item, position=integer(f"cast({i} + 1 as bigint)"), last=integer(f"cast(size({whole}) as bigint)"), where=False)
            test = self.value(p, inner)
            keep = f"coalesce({i} + 1 = {test.sql}, false)" if test.type in NUMERIC and not test.node else ebv(test)
            v = replace(v, sql=f"element_at(transform(array({items_of(v)}), {whole} -> filter({whole}, ({x}, {i}) -> {keep})), 1)", seq=True, const=None)
        return v

    def v_Path(self, e: A.Path, place: Place) -> Val:
        if (found := self.inside(e, place, "values")) is not None:
            return found
        rel = self.relation(e, place)
        if rel is not None:
            return self.gathered(rel)
        steps = e.steps
        item: Item | None = place.item
        if not isinstance(steps[0], A.Step):
            if isinstance(steps[0], A.Var) and isinstance(place.vars.get(steps[0].name), Row):
                item = place.vars[steps[0].name]
            elif isinstance(steps[0], A.Context):
                item = place.item
            else:
                item = self.value(steps[0], place)
            steps = steps[1:]
        for step in steps:
            if item is None:
                raise XPathError("XPDY0002", "there is no context item")
            if isinstance(item, Row) and isinstance(step, A.Step):
                item = self.column(item, step)
                if step.predicates and isinstance(item, Val):
                    item = self.filtered(item, step.predicates, place)
            elif isinstance(step, A.Step):
                if not (isinstance(step.test, A.KindTest) and step.test.kind in ("node", "text") and step.axis in ("child", "self") and isinstance(item, Val) and item.node):
                    raise XPathError("XPTY0020", "a step from an atomic value")
            elif isinstance(item, Val) and item.seq:
                x = fresh()
                body = self.value(step, replace(place, item=replace(item, sql=x, seq=False), where=False))
                item = replace(body, sql=f"flatten(transform({item.sql}, {x} -> {items_of(body)}))", seq=True)
            else:
                item = self.value(step, replace(place, item=item, where=False))
        return self.atomized(item)  # type: ignore[arg-type]

    def filtered(self, v: Val, predicates: tuple[A.Expr, ...], place: Place) -> Val:
        for p in predicates:
            test = self.value(p, replace(place, item=v, position=integer("1L"), last=integer("1L"), where=False))
            keep = f"{test.sql} = 1" if test.type in NUMERIC and not test.node else ebv(test)
            v = replace(v, sql=f"if({keep}, {v.sql}, null)")
        return v

    def v_Step(self, e: A.Step, place: Place) -> Val:
        return self.v_Path(A.Path(False, (e,)), place)

    def gathered(self, rel: Rel) -> Val:
        """The relation's items as an array, in document order."""
        value = self.atom(rel)
        if value.numeric:  # outside, only the value is known
            value = replace(value, sql=canonical_text(value), numeric=None)
        keys = ", ".join(f"{o} AS o{i}" for i, o in enumerate(rel.order))
        x = fresh()
        items = f"transform(array_sort(collect_list(struct({keys}, {value.sql} AS v))), {x} -> {x}.v)" if keys else f"collect_list({value.sql})"
        found = self.lateral(rel.sql(f"{items} AS v")) or f"({rel.sql(items)})"
        return replace(value, sql=f"coalesce({found}, array())", seq=True)

    # Calls.

    def v_Call(self, e: A.Call, place: Place) -> Val:
        name = _local(e.name)
        if name.startswith("xs:") and len(e.args) == 1:
            return self.v_TypeTest(A.TypeTest("cast", e.args[0], A.SequenceType(name, "?")), place)
        custom = self.static.catalog.custom.get(e.name)
        if custom is None:
            if name in ("position", "last") and not e.args:
                found = place.position if name == "position" else place.last
                if found is None:
                    raise XPathError("XPDY0002", f"{name}() needs a context")
                return found
            special = getattr(self, "f_" + name.replace("-", "_"), None)
            if special is not None:
                return special(e, place)
            if name in _AGGREGATES and e.args and (rel := self.relation(e.args[0], place)) is not None:
                return self.over(name, rel, e, place)
            if not e.args and name in ("string", "string-length", "normalize-space", "number"):
                return self.v_Call(A.Call(name, (A.Context(),)), place)
            if name == "collection":
                return EMPTY
        found = self.static.catalog.find(e.name, len(e.args))
        args = [self.value(a, place) for a in e.args]
        if self.static.mode == "1.0":
            args = [first(a) if name not in ("count", "sum") else a for a in args]
        return found.build(place, *args) if found.needs == "context" else found.build(*args)

    def over(self, name: str, rel: Rel, e: A.Call, place: Place) -> Val:
        """An aggregate over a path: one aggregate query, never a gathered sequence."""
        if name in ("exists", "boolean", "empty", "not", "count") and (number := self.inside(e.args[0], place, "count")) is not None:
            return number if name == "count" else boolean(f"({number.sql} {'>' if name in ('exists', 'boolean') else '='} 0)")
        if name in ("exists", "boolean", "empty", "not"):
            found = self.any(rel, place)
            return boolean(found if name in ("exists", "boolean") else f"(NOT {found})")
        value = self.atom(rel)
        if name == "string-join":
            joined = self.gathered(replace(rel, item=string(as_text(value))))
            return strings.string_join(joined, self.value(e.args[1], place))
        out = self.aggregate(name, value)
        missing = "null"
        if name == "sum" and len(e.args) == 2:
            zero = self.value(e.args[1], place)
            out = replace(out, sql=f"if(count(1) = 0, null, {out.sql})")
            missing = zero.sql if zero.type != "empty" else "null"
        elif name in ("count", "sum"):
            missing = f"cast(0 as {SQL_OF[out.type]})"
        found = self.lateral(rel.sql(f"{out.sql} AS v")) or f"({rel.sql(out.sql)})"
        return replace(out, sql=found if missing == "null" else f"coalesce({found}, {missing})")

    def f_deep_equal(self, e: A.Call, place: Place) -> Val:
        """Over nodes the canonical forms of their subtrees are compared, over other items their values."""
        sides = [self.relation(x, place) for x in e.args[:2]]
        if not all(r is not None and isinstance(r.item, Node) for r in sides):
            return self.static.catalog.find("deep-equal", len(e.args)).build(*(self.value(x, place) for x in e.args))
        forms = [self.gathered(self.canonical(r)) for r in sides]  # type: ignore[arg-type]
        return boolean(f"({forms[0].sql} = {forms[1].sql})")

    def canonical(self, rel: Rel) -> Rel:
        """The relation's nodes as texts that are equal for deep-equal subtrees: attributes by name, no comments, instructions or prefixes."""
        n, d, h = rel.item.alias, fresh("n"), fresh("h")  # type: ignore[union-attr]
        attribute = f"{d}.kind = 'attribute'"
        place = f"if({attribute}, {d}.parent, {d}.pre), if({attribute}, concat({d}.ns, ' ', {d}.local), '')"
        text = f"if({d}.kind = 'element', '', {d}.value)"
        part = f"struct({place}, {d}.depth AS depth, concat_ws(chr(1), {d}.kind, {d}.ns, {d}.local, {text}) AS s)"
        inside = f"{d}.doc = {n}.doc AND {d}.pre >= {n}.pre AND {d}.pre <= {n}.post AND ({d}.kind IN ('element', 'attribute', 'text') OR {d}.pre = {n}.pre)"
        # The node itself comes first; depths count from its own.
        form = "array_join(transform(a, x -> concat(cast(x.depth - a[0].depth as string), chr(1), x.s)), chr(2))"
        beside = f"LATERAL (SELECT {form} AS v FROM (SELECT array_sort(collect_list({part})) AS a FROM `{self.static.nodes}` {d} WHERE {inside})) {h}"
        return replace(rel, frm=(*rel.frm, beside), item=string(f"{h}.v"))

    def _node_argument(self, e: A.Call, place: Place, at: int = 0) -> A.Expr:
        return e.args[at] if len(e.args) > at else A.Context()

    def _named(self, e: A.Call, place: Place, column: str) -> str | None:
        """The SQL of a node column of the argument; None for the empty sequence. A table's nodes have fixed names."""
        argument = self._node_argument(e, place)
        item = place.vars.get(argument.name) if isinstance(argument, A.Var) else place.item if isinstance(argument, A.Context) else None
        fixed = "row" if isinstance(item, Row) else None
        if isinstance(item, Val) and item.node and "`" in item.sql:
            fixed = item.sql.split("`")[1]
        if isinstance(argument, A.Path) and fixed is None and argument.steps and isinstance(argument.steps[-1], A.Step) and isinstance(argument.steps[-1].test, A.NameTest):
            owner = place.vars.get(argument.steps[0].name) if isinstance(argument.steps[0], A.Var) else place.item
            if isinstance(owner, Row):
                fixed = argument.steps[-1].test.local
        if fixed is not None:
            return text_literal({"local": fixed, "prefix": "", "ns": ""}.get(column, ""))
        node = self.node(argument, place)
        return None if node is None else node(column)

    def f_name(self, e: A.Call, place: Place) -> Val:
        local = self._named(e, place, "local")
        if local is None:
            return string("''")
        return string(f"concat_ws(':', nullif({self._named(e, place, 'prefix')}, ''), nullif(coalesce({local}, ''), ''))")

    def f_local_name(self, e: A.Call, place: Place) -> Val:
        return string(f"coalesce({self._named(e, place, 'local') or 'null'}, '')")

    def f_namespace_uri(self, e: A.Call, place: Place) -> Val:
        return Val(f"coalesce({self._named(e, place, 'ns') or 'null'}, '')", "anyURI")

    def f_node_name(self, e: A.Call, place: Place) -> Val:
        parts = [self._named(e, place, c) for c in ("ns", "prefix", "local")]
        if parts[2] is None:
            return EMPTY
        return Val(f"if(coalesce({parts[2]}, '') = '', null, named_struct('ns', {parts[0]}, 'prefix', {parts[1]}, 'local', {parts[2]}))", "QName")

    def f_nilled(self, e: A.Call, place: Place) -> Val:
        node = self.node(self._node_argument(e, place), place)
        return EMPTY if node is None else boolean(f"if({node('kind')} = 'element', {node('is_nil')}, null)")

    def f_base_uri(self, e: A.Call, place: Place) -> Val:
        node = self.node(self._node_argument(e, place), place)
        return EMPTY if node is None else Val(node("base_uri"), "anyURI")

    def f_document_uri(self, e: A.Call, place: Place) -> Val:
        node = self.node(self._node_argument(e, place), place)
        return EMPTY if node is None else Val(f"if({node('kind')} = 'document', {node('base_uri')}, null)", "anyURI")

    def f_lang(self, e: A.Call, place: Place) -> Val:
        node = self.node(self._node_argument(e, place, 1), place)
        wanted = f"lower({strings.text(self.value(e.args[0], place))})"
        own = f"lower({node('lang')})"
        return boolean(f"coalesce({own} = {wanted} or startswith({own}, concat({wanted}, '-')), false)")

    def f_root(self, e: A.Call, place: Place) -> Val:
        node = self.node(self._node_argument(e, place), place)
        if node is None:
            return EMPTY
        n = fresh("n")
        return Val(f"(SELECT min_by({n}.value, {n}.pre) FROM `{self.static.nodes}` {n} WHERE {n}.doc = {node('doc')} AND {n}.pre = 0)", "untyped", node=True)

    def f_in_scope_prefixes(self, e: A.Call, place: Place) -> Val:
        return Val(f"map_keys({self.node(e.args[0], place)('ns_bindings')})", "string", seq=True)

    def f_namespace_uri_for_prefix(self, e: A.Call, place: Place) -> Val:
        return Val(f"try_element_at({self.node(e.args[1], place)('ns_bindings')}, {strings.text(self.value(e.args[0], place))})", "anyURI")

    def f_resolve_QName(self, e: A.Call, place: Place) -> Val:
        text = as_text(self.value(e.args[0], place))
        prefix = f"if(contains({text}, ':'), substring_index({text}, ':', 1), '')"
        found = f"try_element_at({self.node(e.args[1], place)('ns_bindings')}, {prefix})"
        bad = f"{prefix} <> '' and {found} is null"
        return Val(f"case when {text} is null then null when {bad} then {error('FONS0004', 'unknown prefix')} else named_struct('ns', coalesce({found}, ''), 'prefix', {prefix}, 'local', substring_index({text}, ':', -1)) end", "QName")

    def f_QName(self, e: A.Call, place: Place) -> Val:
        uri, name = (strings.text(self.value(a, place)) for a in e.args)
        bad = f"not ({lexical.valid(name, 'QName')}) or {uri} = '' and contains({name}, ':')"
        return Val(f"case when {bad} then {error('FOCA0002', 'no QName')} else named_struct('ns', {uri}, 'prefix', if(contains({name}, ':'), substring_index({name}, ':', 1), ''), 'local', substring_index({name}, ':', -1)) end", "QName")

    def _of_qname(self, e: A.Call, place: Place, column: str, kind: str) -> Val:
        v = one(self.value(e.args[0], place))
        if v.type == "empty":
            return EMPTY
        if v.type != "QName":
            raise XPathError("XPTY0004", "a QName is wanted")
        return Val(f"{v.sql}.{column}" if column != "prefix" else f"nullif({v.sql}.prefix, '')", kind)

    def f_prefix_from_QName(self, e: A.Call, place: Place) -> Val:
        return self._of_qname(e, place, "prefix", "string")

    def f_local_name_from_QName(self, e: A.Call, place: Place) -> Val:
        return self._of_qname(e, place, "local", "string")

    def f_namespace_uri_from_QName(self, e: A.Call, place: Place) -> Val:
        return self._of_qname(e, place, "ns", "anyURI")


def compiled(text: str, static: Static) -> tuple[Compiler, Rel | Val]:
    """The plan of an expression: a relation or a single value."""
    compiler, tree = Compiler(static), parse(text, static.mode)
    place = Place(static, vars=dict(static.variables))
    rel = compiler.relation(tree, place)
    if rel is not None:
        return compiler, rel
    rel, value = compiler.with_beside(Rel(("(SELECT 1)",), (), EMPTY), lambda: compiler.value(tree, place))
    return compiler, replace(rel, item=value) if len(rel.frm) > 1 else value
