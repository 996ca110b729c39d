"""Compiling schema documents: parsing, composition, resolution, derivation and their checks.

Everything here runs on the driver, once for a schema. The result is small: it
grows with the schema, not with the data, so the validator may broadcast it.
"""

from __future__ import annotations

import os
import xml.parsers.expat as expat
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from urllib.parse import urljoin

from treequill.operators import facets
from treequill.operators.facets import Simple
from treequill.types import lexical
from treequill.xpath.errors import XPathError

XS = "http://www.w3.org/2001/XMLSchema"
VC = "http://www.w3.org/2007/XMLSchema-versioning"
XML = "http://www.w3.org/XML/1998/namespace"
QName = tuple[str, str]


class SchemaError(XPathError):
    """A schema that breaks one of the rules that codes such as src-resolve name."""


# Documents.


@dataclass
class El:
    ns: str
    local: str
    attrs: dict[str, str]
    scope: dict[str, str]
    children: list[El] = field(default_factory=list)
    text: str = ""

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def kids(self, *names: str) -> list[El]:
        return [c for c in self.children if c.ns == XS and (not names or c.local in names)]

    def first(self, *names: str) -> El | None:
        found = self.kids(*names)
        return found[0] if found else None

    def qname(self, text: str) -> QName:
        prefix, _, local = text.strip().rpartition(":")
        if prefix and prefix not in self.scope:
            raise SchemaError("src-resolve", f"unbound prefix {prefix!r}")
        return self.scope.get(prefix, ""), local


def parse_document(text: str) -> El:
    stack: list[El] = []
    root: list[El] = []
    parser = expat.ParserCreate()
    scopes: list[dict[str, str]] = [{"xml": XML}]

    def start(name: str, attrs: dict[str, str]) -> None:
        scope = {**scopes[-1], **{k[6:]: v for k, v in attrs.items() if k == "xmlns" or k.startswith("xmlns:")}}
        scopes.append(scope)
        prefix, _, local = name.rpartition(":")
        own = {}
        for k, v in attrs.items():
            if k == "xmlns" or k.startswith("xmlns:"):
                continue
            p, _, n = k.rpartition(":")
            own[f"{{{scope.get(p, '')}}}{n}" if p else n] = v
        el = El(scope.get(prefix, ""), local, own, scope)
        (stack[-1].children if stack else root).append(el)
        stack.append(el)

    def end(name: str) -> None:
        stack.pop()
        scopes.pop()

    def characters(data: str) -> None:
        if stack:
            stack[-1].text += data

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(text.encode(), True)
    except expat.ExpatError as e:
        raise SchemaError("sch-props-correct", str(e)) from e
    return root[0]


class FileLoader:
    """Schema documents from files below a folder."""

    def __init__(self, base: str) -> None:
        self.base = base

    def __call__(self, location: str) -> str | None:
        path = os.path.join(self.base, location)
        if not os.path.isfile(path):
            return None
        with open(path, encoding="utf-8") as file:
            return file.read()


#: What the xml: attributes are, for schemas that import their namespace.
EMBEDDED = {
    XML: f'<xs:schema xmlns:xs="{XS}" targetNamespace="{XML}"><xs:attribute name="lang" type="xs:string"/><xs:attribute name="space" type="xs:NCName"/>'
    '<xs:attribute name="base" type="xs:anyURI"/><xs:attribute name="id" type="xs:ID"/></xs:schema>'
}


class Chain:
    """The first loader that has a document; then embedded documents by namespace."""

    def __init__(self, *loaders: Callable[[str], str | None] | Mapping[str, str]) -> None:
        self.loaders = loaders

    def __call__(self, location: str) -> str | None:
        for loader in self.loaders:
            found = loader(location) if callable(loader) else loader.get(location)
            if found is not None:
                return found
        return None


# Components.


@dataclass(frozen=True)
class Wildcard:
    #: ("any",), ("other", target), ("in", names) or ("not", names).
    namespaces: tuple
    process: str = "strict"
    not_names: frozenset[QName] = frozenset()

    def admits(self, ns: str, local: str | None = None) -> bool:
        kind, *rest = self.namespaces
        fits = kind == "any" or kind == "other" and ns not in ("", rest[0]) or kind == "in" and ns in rest[0] or kind == "not" and ns not in rest[0]
        return fits and (local is None or (ns, local) not in self.not_names)


@dataclass(eq=False)
class Attribute:
    name: QName
    type: Simple
    required: bool = False
    default: str | None = None
    fixed: str | None = None
    prohibited: bool = False
    inheritable: bool = False


@dataclass(eq=False)
class Particle:
    kind: str  # element, any, sequence, choice, all
    least: int = 1
    most: int | None = 1
    children: list[Particle] = field(default_factory=list)
    element: Element | None = None
    wildcard: Wildcard | None = None


@dataclass(eq=False)
class Complex:
    name: str
    base: Complex | Simple | None = None
    derivation: str = "restriction"
    mixed: bool = False
    particle: Particle | None = None
    simple: Simple | None = None
    attributes: dict[QName, Attribute] = field(default_factory=dict)
    any_attribute: Wildcard | None = None
    abstract: bool = False
    block: frozenset[str] = frozenset()
    final: frozenset[str] = frozenset()
    assertions: list[tuple[str, dict[str, str]]] = field(default_factory=list)
    #: ("interleave" | "suffix", wildcard)
    open_content: tuple[str, Wildcard] | None = None
    qname: QName | None = None

    @property
    def content(self) -> str:
        if self.simple is not None:
            return "simple"
        if self.particle is None and self.open_content is None:
            return "mixed" if self.mixed else "empty"
        return "mixed" if self.mixed else "element"

    def chain(self):
        at: Complex | Simple | None = self
        while at is not None:
            yield at
            at = at.base if isinstance(at, Complex) else None


Type = Complex | Simple


@dataclass(eq=False)
class Element:
    name: QName
    type: Type | None = None
    nillable: bool = False
    default: str | None = None
    fixed: str | None = None
    abstract: bool = False
    is_global: bool = False
    heads: list[QName] = field(default_factory=list)
    block: frozenset[str] = frozenset()
    final: frozenset[str] = frozenset()
    #: (kind, name, selector, fields, refer, namespaces)
    constraints: list[tuple[str, str, str, tuple[str, ...], str | None, dict[str, str]]] = field(default_factory=list)
    #: (test or None, type, namespaces)
    alternatives: list[tuple[str | None, Type, dict[str, str]]] = field(default_factory=list)


ANY_TYPE = Complex("anyType", mixed=True, particle=Particle("any", 0, None, wildcard=Wildcard(("any",), "lax")), any_attribute=Wildcard(("any",), "lax"), qname=(XS, "anyType"))


def derives(kind: Type, base: Type) -> bool:
    """Is ``kind`` the type ``base`` or derived from it?"""
    if kind is base or base is ANY_TYPE:
        return True
    if isinstance(kind, Simple):
        if isinstance(base, Simple):
            return base.name in kind.ancestors or base.variety == "union" and any(derives(kind, m) for m in base.members)
        return False
    return any(at is base or isinstance(at, Simple) and isinstance(base, Simple) and derives(at, base) for at in kind.chain())


class Schema:
    """A set of compiled components."""

    def __init__(self, version: str = "1.1") -> None:
        self.version = version
        self.types: dict[QName, Type] = {(XS, n): facets.builtin(n) for n in lexical.TYPES} | {(XS, "anyType"): ANY_TYPE}
        self.elements: dict[QName, Element] = {}
        self.attributes: dict[QName, Attribute] = {}
        self.notations: set[QName] = set()
        self.namespaces: set[str] = set()
        self.annotations: list[tuple[str, str]] = []

    def substitutes(self, head: Element) -> list[Element]:
        """The non-abstract elements that may stand for ``head``, itself included."""
        out, seen, todo = [], {head.name}, [head]
        while todo:
            at = todo.pop()
            if not at.abstract:
                out.append(at)
            if "substitution" in head.block:
                break
            for e in self.elements.values():
                if at.name in e.heads and e.name not in seen and e.type is not None and head.type is not None and self._may_substitute(e.type, head):
                    seen.add(e.name)
                    todo.append(e)
        return out

    def _may_substitute(self, kind: Type, head: Element) -> bool:
        at = kind
        while at is not head.type and isinstance(at, Complex):
            if at.derivation in head.block:
                return False
            if at.base is None:
                break
            at = at.base
        return True

    def describe(self) -> list[tuple[str, str, str, str]]:
        """(component, namespace, name, type) of the global components."""
        name = lambda t: t.name if t is not None else ""
        return (
            [("element", *q, name(e.type)) for q, e in self.elements.items()]
            + [("attribute", *q, a.type.name) for q, a in self.attributes.items()]
            + [("type", *q, t.content if isinstance(t, Complex) else t.variety) for q, t in self.types.items() if q[0] != XS]
        )

    def expected(self, type_name: QName) -> tuple[list[QName], list[QName]]:
        """Names of the elements and attributes that a complex type's content may have."""
        kind = self.types[type_name]
        if not isinstance(kind, Complex):
            return [], []
        names = [e.name for p in leaves(kind.particle) if p.element for e in self.substitutes(p.element)]
        return list(dict.fromkeys(names)), list(kind.attributes)


def leaves(p: Particle | None):
    if p is None:
        return
    if p.kind in ("element", "any"):
        yield p
    for c in p.children:
        yield from leaves(c)


#: How wildcards treat what they match, the loosest first.
PROCESS = ("skip", "lax", "strict")


def wildcards(t: Complex) -> list[Wildcard]:
    """The wildcards of a type's content; a name that several admit is treated as the loosest says."""
    return [p.wildcard for p in leaves(t.particle) if p.wildcard] + ([t.open_content[1]] if t.open_content else [])


_FACETS = facets.FACETS
_TOP = {"element", "attribute", "simpleType", "complexType", "group", "attributeGroup", "notation"}


class Builder:
    """Collects schema documents and compiles them."""

    def __init__(self, version: str = "1.1", loader: Callable[[str], str | None] | Mapping[str, str] | None = None) -> None:
        self.schema = Schema(version)
        self.loader = Chain(loader or {})
        #: (kind, name) -> (element, target namespace, its document's root)
        self.sources: dict[tuple[str, QName], tuple[El, str, El]] = {}
        self.loaded: set[tuple[str, str]] = set()
        self.busy: set[tuple[str, QName]] = set()
        self.groups: dict[QName, Particle | None] = {}
        self.keys: dict[str, str] = {}

    def add(self, text: str, location: str = "") -> Builder:
        self.document(parse_document(text), None, location)
        return self

    # Composition.

    def document(self, root: El, chameleon: str | None, location: str, replaced: dict[tuple[str, str], El] | None = None) -> None:
        if (root.ns, root.local) != (XS, "schema"):
            raise SchemaError("sch-props-correct", f"{root.local} is no schema")
        target = root.get("targetNamespace")
        if target == "":
            raise SchemaError("sch-props-correct", "an empty target namespace")
        if chameleon is not None and target is None:
            # Unprefixed references of a document without a namespace go along with it.
            self.rename(root, chameleon)
            target = chameleon
        target = target or ""
        self.schema.namespaces.add(target)
        for el in root.kids():
            if self.version_skips(el):
                continue
            if el.local in ("include", "redefine", "override"):
                self.include(el, target, location)
            elif el.local == "import":
                self.import_(el, target, location)
            elif el.local in _TOP:
                name = el.get("name")
                if not name:
                    raise SchemaError(f"src-{el.local.lower()}", "a global component needs a name")
                put = (replaced or {}).get((el.local, name), el)
                self.put(put.local, (target, name), put, target, root)
            elif el.local == "annotation":
                self.schema.annotations += [(a.local, a.text.strip()) for a in el.kids("documentation", "appinfo")]
            elif el.local not in ("defaultOpenContent",):
                raise SchemaError("s4s-elt-invalid-content", f"{el.local} in a schema")

    def rename(self, el: El, ns: str) -> None:
        el.scope = {**el.scope, "": el.scope.get("") or ns}
        for c in el.children:
            self.rename(c, ns)

    def version_skips(self, el: El) -> bool:
        least, most = el.get(f"{{{VC}}}minVersion"), el.get(f"{{{VC}}}maxVersion")
        own = float(self.schema.version)
        known = el.get(f"{{{VC}}}typeAvailable")
        missing = known is not None and any(el.qname(t) not in self.schema.types for t in known.split())
        return least is not None and own < float(least) or most is not None and own >= float(most) or missing

    def put(self, kind: str, name: QName, el: El, target: str, root: El) -> None:
        group = "type" if kind in ("simpleType", "complexType") else kind
        old = self.sources.get((group, name))
        if old is not None and old[0] is not el:
            raise SchemaError("sch-props-correct", f"{kind} {name[1]} is declared twice")
        self.sources[group, name] = (el, target, root)

    def include(self, el: El, target: str, location: str) -> None:
        where = el.get("schemaLocation")
        if where is None:
            raise SchemaError("src-include", "a location is missing")
        changes = {(c.local, c.get("name") or ""): c for c in el.kids("simpleType", "complexType", "group", "attributeGroup", "element", "attribute")}
        key = (urljoin(location, where), target)
        if key in self.loaded and not changes:
            return
        self.loaded.add(key)
        text = self.loader(urljoin(location, where)) or self.loader(where)
        if text is None:
            return
        root = parse_document(text)
        own = root.get("targetNamespace")
        if own is not None and own != target:
            raise SchemaError("src-include", f"{where} has another namespace")
        if el.local == "override":
            if self.schema.version == "1.0":
                raise SchemaError("src-override", "override is not in version 1.0")
            self.document(root, target, key[0], changes)
            return
        if el.local == "redefine":
            for (kind, name), new in changes.items():
                old = next((c for c in root.kids(kind) if c.get("name") == name), None)
                if old is None:
                    raise SchemaError("src-redefine", f"{name} is not in {where}")
                self.redefined(old, new, name, target)
        self.document(root, target, key[0])

    def redefined(self, old: El, new: El, name: str, target: str) -> None:
        """The new definition takes the name; the old one, which it is made of, gets another."""
        hidden = f"{name}#"
        position = {"base": ("restriction", "extension"), "ref": ("group", "attributeGroup")}
        found = False
        todo = [new]
        while todo:
            el = todo.pop()
            for attribute, kinds in position.items():
                if el.local in kinds and el.get(attribute) and el.qname(el.attrs[attribute])[1] == name:
                    prefix, colon, _ = el.attrs[attribute].rpartition(":")
                    el.attrs[attribute] = f"{prefix}{colon}{hidden}"
                    found = True
            todo += el.children
        if not found and new.local in ("simpleType", "complexType"):
            raise SchemaError("src-redefine", f"{name} is not derived from itself")
        copy = El(old.ns, old.local, {**old.attrs, "name": hidden}, old.scope, old.children, old.text)
        self.put(old.local, (target, hidden), copy, target, copy)
        old.attrs, old.children, old.scope = new.attrs, new.children, new.scope

    def import_(self, el: El, target: str, location: str) -> None:
        ns, where = el.get("namespace") or "", el.get("schemaLocation")
        if ns == target:
            raise SchemaError("src-import", "a schema imports its own namespace")
        key = (urljoin(location, where or ""), ns)
        if key in self.loaded:
            return
        self.loaded.add(key)
        text = (self.loader(urljoin(location, where)) or self.loader(where)) if where else None
        text = text or self.loader(ns) or EMBEDDED.get(ns)
        if text is None:
            return
        root = parse_document(text)
        if (root.get("targetNamespace") or "") != ns:
            raise SchemaError("src-import", f"{where} has another namespace")
        self.document(root, None, key[0])

    # Resolution.

    def compile(self) -> Schema:
        for group, name in list(self.sources):
            getattr(self, {"type": "type", "element": "element", "attribute": "attribute", "group": "group", "attributeGroup": "attribute_group", "notation": "notation"}[group])(name)
        for name, refer in self.keys.items():
            if refer and refer not in self.keys:
                raise SchemaError("src-resolve", f"keyref {name} refers to no key")
        from treequill.xsd.content import check_schema

        check_schema(self.schema)
        return self.schema

    def source(self, group: str, name: QName) -> tuple[El, str, El]:
        found = self.sources.get((group, name))
        if found is None:
            raise SchemaError("src-resolve", f"no {group} is called {{{name[0]}}}{name[1]}")
        return found

    def type(self, name: QName) -> Type:
        found = self.schema.types.get(name)
        if found is not None:
            return found
        if name[0] == XS:
            raise SchemaError("src-resolve", f"no type is called xs:{name[1]}")
        el, target, root = self.source("type", name)
        if ("type", name) in self.busy:
            raise SchemaError("st-props-correct" if el.local == "simpleType" else "ct-props-correct.3", f"type {name[1]} is derived from itself")
        self.busy.add(("type", name))
        out: Type
        if el.local == "simpleType":
            out = self.simple(el, target, name[1])
        else:
            # A complex type's content may mention the type itself: it is known before it is complete.
            shell = Complex(name[1], qname=name)
            base = self.base_of(el)
            if base is not None and base != name and base[0] != XS:
                self.type(base)
            elif base == name:
                raise SchemaError("ct-props-correct.3", f"type {name[1]} is derived from itself")
            self.schema.types[name] = shell
            self.complex(el, target, root, shell)
            out = shell
        self.busy.discard(("type", name))
        self.schema.types[name] = out
        return out

    def base_of(self, el: El) -> QName | None:
        content = el.first("simpleContent", "complexContent")
        step = content.first("restriction", "extension") if content else None
        return step.qname(step.attrs["base"]) if step is not None and step.get("base") else None

    def simple(self, el: El, target: str, name: str) -> Simple:
        step = el.first("restriction", "list", "union")
        if step is None:
            raise SchemaError("src-simple-type", f"{name} has no variety")
        inline = [self.simple(c, target, f"{name}/{i}") for i, c in enumerate(step.kids("simpleType"))]
        if step.local == "list":
            item = self.simple_ref(step, "itemType") if step.get("itemType") else inline[0] if inline else None
            if item is None or step.get("itemType") and inline:
                raise SchemaError("src-list-itemType-or-simpleType", name)
            return facets.list_of(name, item)
        if step.local == "union":
            named = [self._simple(step.qname(t)) for t in (step.get("memberTypes") or "").split()]
            if not named and not inline:
                raise SchemaError("src-union-memberTypes-or-simpleTypes", name)
            return facets.union_of(name, (*named, *inline))
        base = self.simple_ref(step, "base") if step.get("base") else inline[0] if inline else None
        if base is None or step.get("base") and inline:
            raise SchemaError("src-restriction-base-or-simpleType", name)
        return self.restriction(base, step, name)

    def restriction(self, base: Simple, step: El, name: str) -> Simple:
        found: dict[str, list[str]] = {}
        for f in step.kids(*_FACETS):
            value = f.get("value") if f.local != "assertion" else f.get("test")
            if value is None:
                raise SchemaError("src-simple-type", f"{f.local} has no value")
            if f.local in found and f.local not in ("pattern", "enumeration", "assertion"):
                raise SchemaError("src-simple-type", f"{f.local} twice")
            found.setdefault(f.local, []).append(value)
        if base.primitive == "QName" and "enumeration" in found:
            found["enumeration"] = [v.strip() for v in found["enumeration"]]
        return base.restricted(name, found)

    def simple_ref(self, el: El, attribute: str) -> Simple:
        return self._simple(el.qname(el.attrs[attribute]))

    def _simple(self, name: QName) -> Simple:
        found = self.type(name)
        if isinstance(found, Complex):
            if found.simple is None:
                raise SchemaError("src-resolve", f"{name[1]} is no simple type")
            return found.simple
        return found

    # Complex types.

    def complex(self, el: El, target: str, root: El, out: Complex) -> None:
        block = el.get("block") or root.get("blockDefault") or ""
        final = el.get("final") or root.get("finalDefault") or ""
        all_ = {"extension", "restriction"}
        out.block = frozenset(all_ if block == "#all" else block.split())
        out.final = frozenset(all_ if final == "#all" else final.split())
        out.abstract = el.get("abstract") in ("true", "1")
        out.mixed = el.get("mixed") in ("true", "1")
        content = el.first("simpleContent", "complexContent")
        if content is None:
            out.base = ANY_TYPE
            out.particle = self.model(el, target, root)
            self.uses(el, target, root, out)
            self.opened(el, root, target, out)
            out.assertions = self.asserted(el)
            return
        step = content.first("restriction", "extension")
        if step is None or not step.get("base"):
            raise SchemaError("src-ct", f"{out.name} has no base")
        base = self.type(step.qname(step.attrs["base"]))
        out.base, out.derivation = base, step.local
        if isinstance(base, Complex) and step.local in base.final:
            raise SchemaError("cos-ct-extends" if step.local == "extension" else "derivation-ok-restriction", f"{base.name} is final")
        if content.local == "simpleContent":
            simple = base if isinstance(base, Simple) else base.simple
            if isinstance(base, Simple) and step.local == "restriction":
                raise SchemaError("src-ct", "a restriction of a simple type is a simple type")
            inner = step.first("simpleType")
            if inner is not None:
                simple = self.simple(inner, target, f"{out.name}/content")
            if simple is None:
                raise SchemaError("src-ct", f"{base.name} has no simple content")
            out.simple = self.restriction(simple, step, f"{out.name}/content") if step.local == "restriction" else simple
        else:
            if isinstance(base, Simple):
                raise SchemaError("src-ct", "complex content of a simple type")
            if content.get("mixed") is not None:
                out.mixed = content.get("mixed") in ("true", "1")
            own = self.model(step, target, root)
            if step.local == "extension":
                if base.simple is not None:
                    raise SchemaError("cos-ct-extends", f"{base.name} has simple content")
                if base is not ANY_TYPE and base.particle is not None and own is not None and base.mixed != out.mixed:
                    raise SchemaError("cos-ct-extends", f"{out.name} and {base.name} differ in mixing")
                if own is None:
                    out.particle, out.mixed = base.particle, base.mixed or out.mixed
                elif base.particle is None:
                    out.particle = own
                elif base.particle.kind == "all" and own.kind == "all" and self.schema.version != "1.0":
                    out.particle = replace(base.particle, children=[*base.particle.children, *own.children])
                else:
                    if base.particle.kind == "all" or own.kind == "all":
                        raise SchemaError("cos-all-limited", f"{out.name} puts an all group in a sequence")
                    out.particle = Particle("sequence", 1, 1, [base.particle, own])
                out.open_content = base.open_content
            else:
                out.particle = own
        if isinstance(base, Complex) and base is not ANY_TYPE:
            if step.local == "extension":
                out.attributes = dict(base.attributes)
                out.any_attribute = base.any_attribute
            else:
                out.attributes = dict(base.attributes)
        self.uses(step, target, root, out, base if isinstance(base, Complex) else None, step.local)
        self.opened(step, root, target, out)
        inherited = base.assertions if isinstance(base, Complex) else []
        out.assertions = [*inherited, *self.asserted(step)]

    def asserted(self, el: El) -> list[tuple[str, dict[str, str]]]:
        if self.schema.version == "1.0":
            return []
        return [(a.attrs.get("test", ""), {**a.scope, "": a.scope.get("", "") if a.get("xpathDefaultNamespace") else ""}) for a in el.kids("assert")]

    def opened(self, el: El, root: El, target: str, out: Complex) -> None:
        found = el.first("openContent")
        if found is None:
            found = root.first("defaultOpenContent")
            if found is None or out.particle is None and found.get("appliesToEmpty") not in ("true", "1"):
                return
        mode = found.get("mode") or "interleave"
        if self.schema.version == "1.0":
            raise SchemaError("src-openContent", "open content is not in version 1.0")
        any_ = found.first("any")
        if mode == "none":
            out.open_content = None
        elif any_ is None:
            raise SchemaError("src-openContent", "open content needs a wildcard")
        else:
            out.open_content = (mode, self.wildcard(any_, target))

    def wildcard(self, el: El, target: str) -> Wildcard:
        text, process = el.get("namespace"), el.get("processContents") or "strict"
        own = lambda t: target if t == "##targetNamespace" else "" if t == "##local" else t
        names: tuple
        if el.get("notNamespace") is not None:
            if text is not None:
                raise SchemaError("src-wildcard", "namespace and notNamespace")
            names = ("not", frozenset(map(own, el.attrs["notNamespace"].split())))
        elif text in (None, "##any"):
            names = ("any",)
        elif text == "##other":
            names = ("other", target)
        else:
            names = ("in", frozenset(map(own, text.split())))  # type: ignore[union-attr]
        excluded = frozenset(el.qname(t) for t in (el.get("notQName") or "").split() if not t.startswith("##"))
        if process not in ("strict", "lax", "skip"):
            raise SchemaError("w-props-correct", f"processContents is {process!r}")
        return Wildcard(names, process, excluded)

    # Content models.

    def occurs(self, el: El) -> tuple[int, int | None]:
        least, most = el.get("minOccurs") or "1", el.get("maxOccurs") or "1"
        try:
            low, high = int(least), None if most == "unbounded" else int(most)
        except ValueError as e:
            raise SchemaError("p-props-correct", f"occurs {least} to {most}") from e
        if low < 0 or high is not None and high < low:
            raise SchemaError("p-props-correct", f"occurs {least} to {most}")
        return low, high

    def model(self, el: El, target: str, root: El) -> Particle | None:
        found = el.first("sequence", "choice", "all", "group")
        return None if found is None else self.particle(found, target, root)

    def particle(self, el: El, target: str, root: El) -> Particle | None:
        least, most = self.occurs(el)
        if most == 0:
            return None
        if el.local == "group":
            inner = self.group(el.qname(el.attrs["ref"]))
            return None if inner is None else Particle("sequence", least, most, [inner]) if (least, most) != (1, 1) else inner
        if el.local == "any":
            return Particle("any", least, most, wildcard=self.wildcard(el, target))
        if el.local == "element":
            return Particle("element", least, most, element=self.local(el, target, root))
        children = [p for c in el.kids("element", "any", "sequence", "choice", "all", "group") if not self.version_skips(c) and (p := self.particle(c, target, root)) is not None]
        if el.local == "all":
            if most != 1 or any(c.kind not in ("element", "any", "all") for c in children):
                raise SchemaError("cos-all-limited", "an all group holds elements and occurs once")
            if self.schema.version == "1.0" and any(c.most is None or c.most > 1 for c in children):
                raise SchemaError("cos-all-limited", "an element of an all group occurs more than once")
        elif any(c.kind == "all" for c in children):
            raise SchemaError("cos-all-limited", "an all group stands in another group")
        if not children:
            # An empty choice admits nothing, an empty sequence the empty content.
            return Particle("choice", least, most) if el.local == "choice" and least > 0 else None
        return Particle(el.local, least, most, children)

    def group(self, name: QName) -> Particle | None:
        if name in self.groups:
            return self.groups[name]
        el, target, root = self.source("group", name)
        if ("group", name) in self.busy:
            raise SchemaError("mgd-props-correct", f"group {name[1]} holds itself")
        self.busy.add(("group", name))
        out = self.groups[name] = self.model(el, target, root)
        self.busy.discard(("group", name))
        return out

    def local(self, el: El, target: str, root: El) -> Element:
        if el.get("ref"):
            if el.get("name") or el.get("type"):
                raise SchemaError("src-element", "ref and name")
            return self.element(el.qname(el.attrs["ref"]))
        form = el.get("form") or root.get("elementFormDefault") or "unqualified"
        if not el.get("name"):
            raise SchemaError("src-element", "an element needs a name")
        return self.declared(Element((target if form == "qualified" else "", el.attrs["name"])), el, target, root)

    def element(self, name: QName) -> Element:
        found = self.schema.elements.get(name)
        if found is not None:
            return found
        el, target, root = self.source("element", name)
        out = self.schema.elements[name] = Element(name, is_global=True)
        return self.declared(out, el, target, root)

    def declared(self, out: Element, el: El, target: str, root: El) -> Element:
        all_ = {"extension", "restriction", "substitution"}
        block = el.get("block") or root.get("blockDefault") or ""
        out.block = frozenset(all_ if block == "#all" else block.split())
        out.nillable = el.get("nillable") in ("true", "1")
        out.abstract = el.get("abstract") in ("true", "1")
        out.default, out.fixed = el.get("default"), el.get("fixed")
        if out.default is not None and out.fixed is not None:
            raise SchemaError("src-element", f"{out.name[1]} has a default and a fixed value")
        out.heads = [el.qname(h) for h in (el.get("substitutionGroup") or "").split()]
        inline = el.first("simpleType", "complexType")
        if el.get("type") and inline is not None:
            raise SchemaError("src-element", f"{out.name[1]} has two types")
        if el.get("type"):
            out.type = self.type(el.qname(el.attrs["type"]))
        elif inline is not None:
            out.type = self.inline(inline, target, root, out.name[1])
        elif out.heads:
            out.type = self.element(out.heads[0]).type or ANY_TYPE
        else:
            out.type = ANY_TYPE
        for head in out.heads:
            kind = self.element(head).type
            if kind is not None and out.type is not None and not derives(out.type, kind):
                raise SchemaError("e-props-correct.4", f"{out.name[1]} can't substitute {head[1]}")
        for c in el.kids("unique", "key", "keyref"):
            self.constrained(out, c)
        if self.schema.version != "1.0":
            for a in el.kids("alternative"):
                kind = self.type(a.qname(a.attrs["type"])) if a.get("type") else self.inline(a.first("simpleType", "complexType"), target, root, out.name[1])  # type: ignore[arg-type]
                out.alternatives.append((a.get("test"), kind, a.scope))
        value = out.default if out.default is not None else out.fixed
        simple = out.type if isinstance(out.type, Simple) else out.type.simple
        if value is not None and simple is None and not (isinstance(out.type, Complex) and out.type.mixed):
            raise SchemaError("cos-valid-default", f"{out.name[1]} has a value but no simple content")
        if value is not None and simple is not None and "ID" in simple.ancestors:
            raise SchemaError("e-props-correct.2", f"{out.name[1]} is an ID with a value")
        return out

    def inline(self, el: El, target: str, root: El, name: str) -> Type:
        if el.local == "simpleType":
            return self.simple(el, target, f"{name}/type")
        out = Complex(f"{name}/type")
        self.complex(el, target, root, out)
        return out

    def constrained(self, out: Element, c: El) -> None:
        from treequill.operators.identity import restricted

        name, selector, fields = c.get("name"), c.first("selector"), c.kids("field")
        if not name or selector is None or not fields:
            raise SchemaError("src-identity-constraint", "a constraint needs a name, a selector and fields")
        paths = [selector.attrs.get("xpath", ""), *(f.attrs.get("xpath", "") for f in fields)]
        restricted(paths[0], False)
        for p in paths[1:]:
            restricted(p, True)
        refer = c.qname(c.attrs["refer"])[1] if c.get("refer") else None
        if (c.local == "keyref") != (refer is not None):
            raise SchemaError("src-identity-constraint", f"{name}: only a keyref refers to a key")
        if name in self.keys:
            raise SchemaError("sch-props-correct", f"constraint {name} is declared twice")
        self.keys[name] = refer or ""
        out.constraints.append((c.local, name, paths[0], tuple(paths[1:]), refer, c.scope))

    # Attributes.

    def attribute(self, name: QName) -> Attribute:
        found = self.schema.attributes.get(name)
        if found is None:
            el, target, _ = self.source("attribute", name)
            found = self.schema.attributes[name] = self.valued(Attribute(name, self.attribute_type(el, target)), el)
        return found

    def attribute_type(self, el: El, target: str) -> Simple:
        inner = el.first("simpleType")
        if el.get("type") and inner is not None:
            raise SchemaError("src-attribute", "an attribute has two types")
        if el.get("type"):
            kind = self.type(el.qname(el.attrs["type"]))
            if isinstance(kind, Complex):
                raise SchemaError("src-resolve", "an attribute's type is simple")
            return kind
        return self.simple(inner, target, f"{el.get('name')}/type") if inner is not None else facets.builtin("anySimpleType")

    def valued(self, out: Attribute, el: El) -> Attribute:
        out.default, out.fixed = el.get("default", out.default), el.get("fixed", out.fixed)
        out.required, out.prohibited = el.get("use") == "required", el.get("use") == "prohibited"
        out.inheritable = el.get("inheritable") in ("true", "1")
        if el.get("default") is not None and (el.get("fixed") is not None or el.get("use") not in (None, "optional")):
            raise SchemaError("src-attribute", f"{out.name[1]} has a default and is fixed or not optional")
        if "ID" in out.type.ancestors and (out.default or out.fixed):
            raise SchemaError("a-props-correct", f"{out.name[1]} is an ID with a value")
        if out.name[1] == "xmlns":
            raise SchemaError("no-xmlns", "an attribute is called xmlns")
        return out

    def uses(self, el: El, target: str, root: El, out: Complex, base: Complex | None = None, derivation: str = "") -> None:
        own: dict[QName, Attribute] = {}
        wild = self.collect(el, target, root, own, ())
        if base is None and derivation == "" and root.get("defaultAttributes") and el.get("defaultAttributesApply") not in ("false", "0"):
            self.attribute_group_into(root.qname(root.attrs["defaultAttributes"]), own, ())
        ids = [a for a in own.values() if "ID" in a.type.ancestors]
        if len(ids) > 1 and self.schema.version == "1.0":
            raise SchemaError("ct-props-correct", f"{out.name} has two IDs")
        for name, a in own.items():
            old = out.attributes.get(name)
            if derivation == "extension" and old is not None:
                raise SchemaError("ct-props-correct", f"{out.name} repeats attribute {name[1]}")
            if derivation == "restriction" and base is not None and base is not ANY_TYPE:
                if old is None and not a.prohibited and not (base.any_attribute and base.any_attribute.admits(*name)):
                    raise SchemaError("derivation-ok-restriction", f"{out.name} adds attribute {name[1]}")
                if old is not None and old.required and not a.required:
                    raise SchemaError("derivation-ok-restriction", f"{out.name} drops the required attribute {name[1]}")
                if old is not None and not a.prohibited and not derives(a.type, old.type):
                    raise SchemaError("derivation-ok-restriction", f"{out.name} changes the type of attribute {name[1]}")
            if a.prohibited:
                out.attributes.pop(name, None)
            else:
                out.attributes[name] = a
        if derivation == "restriction" and wild is not None and base is not None and base is not ANY_TYPE and base.any_attribute is None:
            raise SchemaError("derivation-ok-restriction", f"{out.name} adds an attribute wildcard")
        out.any_attribute = wild if wild is not None else out.any_attribute if derivation == "extension" else None

    def collect(self, el: El, target: str, root: El, own: dict[QName, Attribute], trail: tuple[QName, ...]) -> Wildcard | None:
        wild = None
        for c in el.kids("attribute", "attributeGroup", "anyAttribute"):
            if c.local == "anyAttribute":
                wild = self.wildcard(c, target)
            elif c.local == "attributeGroup":
                wild = self.attribute_group_into(c.qname(c.attrs["ref"]), own, trail) or wild
            else:
                if c.get("ref"):
                    known = self.attribute(c.qname(c.attrs["ref"]))
                    a = self.valued(Attribute(known.name, known.type, default=known.default, fixed=known.fixed), c)
                else:
                    if not c.get("name"):
                        raise SchemaError("src-attribute", "an attribute needs a name")
                    form = c.get("form") or root.get("attributeFormDefault") or "unqualified"
                    a = self.valued(Attribute((target if form == "qualified" else "", c.attrs["name"]), self.attribute_type(c, target)), c)
                if a.name in own:
                    raise SchemaError("ct-props-correct", f"attribute {a.name[1]} twice")
                own[a.name] = a
        return wild

    def attribute_group_into(self, name: QName, own: dict[QName, Attribute], trail: tuple[QName, ...]) -> Wildcard | None:
        if name in trail:
            raise SchemaError("src-attribute_group", f"attribute group {name[1]} holds itself")
        el, target, root = self.source("attributeGroup", name)
        return self.collect(el, target, root, own, (*trail, name))

    def attribute_group(self, name: QName) -> None:
        self.attribute_group_into(name, {}, ())

    def notation(self, name: QName) -> None:
        self.schema.notations.add(name)


def compile_schema(text: str, version: str = "1.1", loader: Callable[[str], str | None] | Mapping[str, str] | None = None, location: str = "") -> Schema:
    return Builder(version, loader).add(text, location).compile()
