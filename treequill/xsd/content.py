"""Content models as regular expressions over one character for each element name, and the checks on models.

A child element's name is one private-use character; names that no declaration
has share a character for each namespace. A model becomes a Java pattern, so a
parent's children are matched by ``rlike`` on their characters in order.
"""

from __future__ import annotations

from dataclasses import dataclass

from treequill.xsd.schema import Complex, Element, Particle, QName, Schema, SchemaError, Simple, Type, Wildcard, derives, leaves

#: Namespace of the names whose namespace the schema never mentions.
ELSEWHERE = "\x00"


@dataclass
class Alphabet:
    """Characters of the names that a schema declares, and of unknown names by namespace."""

    known: dict[QName, str]
    unknown: dict[str, str]

    def members(self, wildcard: Wildcard) -> list[str]:
        out = [c for n, c in self.known.items() if wildcard.admits(*n)]
        for ns, c in self.unknown.items():
            kind, *rest = wildcard.namespaces
            if ns == ELSEWHERE:
                fits = kind in ("any", "other", "not")
            else:
                fits = wildcard.admits(ns)
            if fits:
                out.append(c)
        return out


def components(schema: Schema) -> tuple[list[Element], list[Type]]:
    """All element declarations and types that validation may meet."""
    elements: dict[int, Element] = {}
    types: dict[int, Type] = {}
    todo: list[Element | Type] = [*schema.elements.values(), *schema.types.values()]
    while todo:
        x = todo.pop()
        if isinstance(x, Element):
            if id(x) not in elements:
                elements[id(x)] = x
                todo += [t for t in (x.type, *(a[1] for a in x.alternatives)) if t is not None]
        elif id(x) not in types:
            types[id(x)] = x
            if isinstance(x, Complex):
                todo += [p.element for p in leaves(x.particle) if p.element is not None]
                todo += [t for t in (x.simple,) if t is not None]
    return list(elements.values()), list(types.values())


def alphabet(schema: Schema) -> Alphabet:
    elements, types = components(schema)
    names = sorted({e.name for e in elements})
    spaces = {"", *schema.namespaces, *(n[0] for n in names)}
    for t in types:
        if isinstance(t, Complex):
            for w in [p.wildcard for p in leaves(t.particle)] + [t.open_content[1] if t.open_content else None]:
                if w is not None:
                    spaces |= set().union(*(x if isinstance(x, frozenset) else {x} for x in w.namespaces[1:]))
                    names = sorted({*names, *w.not_names})
    at = iter([*range(0xE000, 0xF8FF), *range(0xF0000, 0xFFFFD)])
    return Alphabet({n: chr(next(at)) for n in names}, {ns: chr(next(at)) for ns in sorted(spaces)} | {ELSEWHERE: chr(next(at))})


def _class(chars: list[str]) -> str:
    return "[" + "".join(sorted(set(chars))) + "]" if chars else "(?!)"


def _times(body: str, least: int, most: int | None) -> str:
    if (least, most) == (1, 1):
        return body
    mark = {(0, 1): "?", (0, None): "*", (1, None): "+"}.get((least, most), f"{{{least},{'' if most is None else most}}}")
    return f"(?:{body}){mark}"


def pattern(p: Particle | None, schema: Schema, names: Alphabet) -> str:
    """The pattern of a particle."""
    if p is None:
        return ""
    if p.kind == "element":
        assert p.element is not None
        members = schema.substitutes(p.element) if p.element.is_global else [p.element]
        body = _class([names.known[e.name] for e in members])
    elif p.kind == "any":
        assert p.wildcard is not None
        body = _class(names.members(p.wildcard))
    elif p.kind == "sequence":
        body = "".join(pattern(c, schema, names) for c in p.children)
    elif p.kind == "choice":
        body = "(?:" + "|".join(pattern(c, schema, names) for c in p.children) + ")" if p.children else "(?!)"
    else:
        body = _all(p, schema, names)
    return _times(body, p.least, p.most)


def _all(p: Particle, schema: Schema, names: Alphabet) -> str:
    """An all group stands alone: each member's count is a lookahead, then only members may follow."""
    own = [(c, pattern(Particle(c.kind, element=c.element, wildcard=c.wildcard), schema, names)) for c in p.children]
    members = "".join(x[1:-1] for _, x in own if x != "(?!)")
    counts = ""
    for c, x in own:
        if c.kind == "element":
            # Elements go before wildcards, so what an element may be counts for it alone.
            counts += f"(?=(?:[^{x[1:-1]}]*{x}){{{c.least},{'' if c.most is None else c.most}}}[^{x[1:-1]}]*$)"
    body = f"{counts}[{members}]*" if members else ""
    return f"(?:{body})" if p.least else f"(?:{body}|)"


def content_pattern(kind: Complex, schema: Schema, names: Alphabet) -> str:
    """The whole pattern of a type's children."""
    body = pattern(kind.particle, schema, names)
    if kind.open_content is None:
        return f"^(?:{body})$"
    mode, wildcard = kind.open_content
    extra = _class(names.members(wildcard))
    if mode == "suffix":
        return f"^(?:{body}){extra}*$"
    # Interleaved: declared names keep their order, other names may stand anywhere.
    own = {c for p in leaves(kind.particle) if p.element for e in schema.substitutes(p.element) for c in [names.known[e.name]]}
    other = _class([c for c in names.members(wildcard) if c not in own])
    return f"^(?:{_interleave(kind.particle, schema, names, other)})$"


def _interleave(p: Particle | None, schema: Schema, names: Alphabet, other: str) -> str:
    if p is None:
        return f"{other}*"
    if p.kind in ("element", "any"):
        return _times(f"{other}*{pattern(Particle(p.kind, element=p.element, wildcard=p.wildcard), schema, names)}", p.least, p.most) + f"{other}*"
    parts = [_interleave(c, schema, names, other) for c in p.children]
    body = "(?:" + "|".join(parts) + ")" if p.kind == "choice" else "".join(parts)
    return _times(f"(?:{body})", p.least, p.most)


# Checks.


def check_schema(schema: Schema) -> None:
    """Raises for a model that isn't deterministic or consistent, or no restriction of its base's."""
    _, types = components(schema)
    for kind in types:
        if isinstance(kind, Complex) and kind.particle is not None:
            check_consistent(kind)
            check_unique(kind, schema)
            if kind.derivation == "restriction" and isinstance(kind.base, Complex) and kind.base.name != "anyType" and kind.qname != kind.base.qname:
                check_restriction(kind, schema)
    for e in schema.elements.values():
        seen, todo = set(), list(e.heads)
        while todo:
            head = todo.pop()
            if head == e.name:
                raise SchemaError("e-props-correct", f"{e.name[1]} substitutes itself")
            if head not in seen and head in schema.elements:
                seen.add(head)
                todo += schema.elements[head].heads


def check_consistent(kind: Complex) -> None:
    """Elements of one name have one type."""
    found: dict[QName, Element] = {}
    for p in leaves(kind.particle):
        if p.element is not None:
            old = found.setdefault(p.element.name, p.element)
            if old.type is not p.element.type:
                raise SchemaError("cos-element-consistent", f"{kind.name} has two types for {p.element.name[1]}")


def _positions(p: Particle | None, leaves_: list[Particle]) -> tuple[bool, set[int], set[int], dict[int, set[int]]]:
    """Nullable, first, last and follow of the positions of a particle, with counts above one as loops."""
    if p is None:
        return True, set(), set(), {}
    follow: dict[int, set[int]] = {}
    if p.kind in ("element", "any"):
        leaves_.append(p)
        here = {len(leaves_) - 1}
        nullable, first, last = False, here, set(here)
    elif p.kind == "choice":
        parts = [_positions(c, leaves_) for c in p.children]
        nullable = any(x[0] for x in parts)
        first, last = set().union(*(x[1] for x in parts)), set().union(*(x[2] for x in parts))
        for x in parts:
            for k, v in x[3].items():
                follow.setdefault(k, set()).update(v)
    else:
        nullable, first, last = True, set(), set()
        for c in p.children:
            n, f, la, fo = _positions(c, leaves_)
            for k, v in fo.items():
                follow.setdefault(k, set()).update(v)
            for k in last:
                follow.setdefault(k, set()).update(f)
            first |= f if nullable else set()
            last = last | la if n else la
            nullable = nullable and n
    if p.most is None or p.most > 1:
        for k in last:
            follow.setdefault(k, set()).update(first)
    return nullable or p.least == 0, first, last, follow


def check_unique(kind: Complex, schema: Schema) -> None:
    """Unique particle attribution: after any position no two of the next ones may take the same name."""
    assert kind.particle is not None
    if kind.particle.kind == "all":
        names = [n for c in kind.particle.children if c.element for n in [e.name for e in schema.substitutes(c.element)]]
        if len(names) != len(set(names)):
            raise SchemaError("cos-nonambig", f"{kind.name} has an element twice in an all group")
        return
    found: list[Particle] = []
    _, first, _, follow = _positions(kind.particle, found)
    for after in (first, *follow.values()):
        order = sorted(after)
        for i, a in enumerate(order):
            for b in order[i + 1 :]:
                if _overlap(found[a], found[b], schema):
                    raise SchemaError("cos-nonambig", f"{kind.name} is ambiguous")


def _overlap(a: Particle, b: Particle, schema: Schema) -> bool:
    if a.element is not None and b.element is not None:
        names = [{e.name for e in (schema.substitutes(x.element) if x.element.is_global else [x.element])} for x in (a, b)]
        return bool(names[0] & names[1])
    if a.wildcard is not None and b.wildcard is not None:
        return _wild_overlap(a.wildcard, b.wildcard)
    element, wildcard = (a.element, b.wildcard) if a.element is not None else (b.element, a.wildcard)
    # In version 1.1 an element goes before a wildcard.
    return schema.version == "1.0" and wildcard.admits(*element.name)  # type: ignore[union-attr]


def _wild_overlap(a: Wildcard, b: Wildcard) -> bool:
    if a.namespaces[0] == "in":
        return any(b.admits(ns) for ns in a.namespaces[1])
    if b.namespaces[0] == "in":
        return any(a.admits(ns) for ns in b.namespaces[1])
    return True


def _range(p: Particle | None) -> tuple[int, int | None]:
    """Least and most elements of a particle."""
    if p is None:
        return 0, 0
    if p.kind in ("element", "any"):
        low, high = 1, 1
    else:
        parts = [_range(c) for c in p.children] or [(0, 0)]
        if p.kind == "choice":
            low, high = min(x[0] for x in parts), None if any(x[1] is None for x in parts) else max(x[1] for x in parts)  # type: ignore[type-var]
        else:
            low, high = sum(x[0] for x in parts), None if any(x[1] is None for x in parts) else sum(x[1] for x in parts)  # type: ignore[misc, assignment]
    return low * p.least, None if p.most is None and high != 0 or high is None else high * (p.most or 0)


def check_restriction(kind: Complex, schema: Schema) -> None:
    """The necessary conditions of a restriction: sizes, names and types of the base's content."""
    base = kind.base
    assert isinstance(base, Complex)
    own, theirs = _range(kind.particle), _range(base.particle)
    if base.open_content is None and (own[1] is None and theirs[1] is not None or own[1] is not None and theirs[1] is not None and own[1] > theirs[1] or own[0] < theirs[0]):
        raise SchemaError("derivation-ok-restriction", f"{kind.name} admits other sizes than {base.name}")
    wild = [p.wildcard for p in leaves(base.particle) if p.wildcard] + ([base.open_content[1]] if base.open_content else [])
    names = {e.name: e for p in leaves(base.particle) if p.element for e in (schema.substitutes(p.element) if p.element.is_global else [p.element])}
    for p in leaves(kind.particle):
        if p.element is None:
            if not wild:
                raise SchemaError("derivation-ok-restriction", f"{kind.name} adds a wildcard")
            continue
        old = names.get(p.element.name)
        if old is None:
            if not any(w.admits(*p.element.name) for w in wild):
                raise SchemaError("derivation-ok-restriction", f"{kind.name} adds {p.element.name[1]}")
        elif old.type is not None and p.element.type is not None and not derives(p.element.type, old.type):
            raise SchemaError("derivation-ok-restriction", f"{kind.name} changes the type of {p.element.name[1]}")
        elif p.element.nillable and not old.nillable:
            raise SchemaError("derivation-ok-restriction", f"{kind.name} makes {p.element.name[1]} nillable")


def simple_of(kind: Type | None) -> Simple | None:
    return kind if isinstance(kind, Simple) else kind.simple if kind is not None else None
