"""Syntax trees of XPath expressions."""

from __future__ import annotations

from dataclasses import dataclass, field


class Expr:
    """Any expression."""


@dataclass(frozen=True)
class Literal(Expr):
    value: object
    type: str  # string, integer, decimal or double


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Context(Expr):
    pass


@dataclass(frozen=True)
class Sequence(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class If(Expr):
    test: Expr
    then: Expr
    other: Expr


@dataclass(frozen=True)
class For(Expr):
    bindings: tuple[tuple[str, Expr], ...]
    body: Expr


@dataclass(frozen=True)
class Quantified(Expr):
    every: bool
    bindings: tuple[tuple[str, Expr], ...]
    test: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Unary(Expr):
    op: str
    operand: Expr


@dataclass(frozen=True)
class NameTest:
    prefix: str | None  # None: none written; "*": any namespace
    local: str  # "*": any


@dataclass(frozen=True)
class KindTest:
    kind: str  # node, text, comment, processing-instruction, document-node, element, attribute, schema-element, schema-attribute
    name: str | None = None
    type: str | None = None
    nillable: bool = False
    inner: KindTest | None = None


@dataclass(frozen=True)
class Step(Expr):
    axis: str
    test: NameTest | KindTest
    predicates: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Filter(Expr):
    """A primary expression with predicates."""

    primary: Expr
    predicates: tuple[Expr, ...] = ()


@dataclass(frozen=True)
class Path(Expr):
    """Steps from the context item, or from the root if ``absolute``."""

    absolute: bool
    steps: tuple[Expr, ...] = field(default=())


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class SequenceType:
    item: str | KindTest  # an atomic type's name, "item()", "empty-sequence()" or a kind test
    occurrence: str = ""  # "", "?", "*" or "+"


@dataclass(frozen=True)
class TypeTest(Expr):
    """instance of, treat as, castable as, cast as."""

    op: str
    operand: Expr
    type: SequenceType


def walk(e: object):
    """``e`` and all expressions below it."""
    yield e
    if isinstance(e, tuple):
        for x in e:
            yield from walk(x)
    elif hasattr(e, "__dataclass_fields__"):
        for name in e.__dataclass_fields__:
            x = getattr(e, name)
            if isinstance(x, tuple) or isinstance(x, Expr):
                yield from walk(x)
