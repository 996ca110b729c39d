"""Numeric, sequence and aggregate functions over in-row sequences."""

from __future__ import annotations

from dataclasses import replace

from treequill.functions.registry import function
from treequill.functions.strings import cast_items, collation
from treequill.functions.values import (
    EMPTY, NUMERIC, SQL_OF, TEXTUAL, Val, arithmetic, as_double, boolean, cast, compare, ebv, error, fresh, general_compare, integer, items_of, number,
)
from treequill.xpath.errors import XPathError


def size(v: Val) -> str:
    if v.type == "empty":
        return "0L"
    return f"cast(size({v.sql}) as bigint)" if v.seq else f"if({v.sql} is null, 0L, 1L)"


@function("true", 0)
def true() -> Val:
    return Val("true", "boolean", const=True)


@function("false", 0)
def false() -> Val:
    return Val("false", "boolean", const=False)


@function("boolean", 1)
def to_boolean(v: Val) -> Val:
    return boolean(ebv(v))


@function("not", 1)
def negate(v: Val) -> Val:
    return boolean(f"(not {ebv(v)})")


@function("empty", 1)
def empty(v: Val) -> Val:
    return boolean(f"({size(v)} = 0)")


@function("exists", 1)
def exists(v: Val) -> Val:
    return boolean(f"({size(v)} > 0)")


@function("count", 1)
def count(v: Val) -> Val:
    return integer(size(v))


@function("number", 1)
def to_number(v: Val) -> Val:
    return Val(as_double(v), "double")


def _numeric(v: Val) -> Val:
    v = number(v)
    if v.type not in (*NUMERIC, "empty"):
        raise XPathError("XPTY0004", f"{v.type} is no number")
    return v


@function("abs", 1)
def absolute(v: Val) -> Val:
    v = _numeric(v)
    return v if v.type == "empty" else Val(f"abs({v.sql})", v.type)


def _rounded(v: Val, exact: str, inexact: str) -> Val:
    """``exact`` for integers and decimals, ``inexact`` for floats, where infinities and NaN pass as they are."""
    v = _numeric(v)
    if v.type in ("integer", "empty"):
        return v
    if v.type == "decimal":
        return Val(f"cast({exact.format(v.sql)} as decimal(38, 18))", v.type)
    whole = f"abs({v.sql}) >= 4503599627370496D or isnan({v.sql})"
    return Val(f"case when {whole} then {v.sql} else cast({inexact.format(v.sql)} as {v.type}) end", v.type)


@function("ceiling", 1)
def ceiling(v: Val) -> Val:
    return _rounded(v, "ceil({0})", "ceil({0})")


@function("floor", 1)
def floor(v: Val) -> Val:
    return _rounded(v, "floor({0})", "floor({0})")


@function("round", 1)
def round_(v: Val) -> Val:
    """Half away from zero."""
    return _rounded(v, "round({0}, 0)", "sign({0}) * floor(abs({0}) + 0.5D)")


@function("round-half-to-even", 1, 2)
def round_half_to_even(v: Val, digits: Val | None = None) -> Val:
    places = 0
    if digits is not None:
        if not isinstance(digits.const, int):
            raise XPathError("XPST0003", "the precision must be a literal")
        places = digits.const
    v = _numeric(v)
    if v.type == "empty" or v.type == "integer" and places >= 0:
        return v
    if v.type in ("integer", "decimal"):
        return Val(f"cast(bround(cast({v.sql} as decimal(38, 18)), {places}) as {SQL_OF[v.type]})", v.type)
    return Val(f"case when isnan({v.sql}) or abs({v.sql}) >= 4503599627370496D then {v.sql} else cast(bround(cast({v.sql} as double), {places}) as {v.type}) end", v.type)


# Sequences.


@function("reverse", 1)
def reverse(v: Val) -> Val:
    return replace(v, sql=f"reverse({v.sql})") if v.seq else v


@function("unordered", 1)
def unordered(v: Val) -> Val:
    return v


@function("trace", 1, 2)
def trace(v: Val, label: Val | None = None) -> Val:
    return v


@function("data", 1)
def data(v: Val) -> Val:
    return replace(v, node=False)


def _cardinality(v: Val, test: str, code: str) -> Val:
    name = fresh()
    bad = error(code, "the sequence has the wrong number of items")
    return replace(v, sql=f"element_at(transform(array({items_of(v)}), {name} -> case when size({name}) {test} then {name} else {bad} end), 1)", seq=True)


@function("zero-or-one", 1)
def zero_or_one(v: Val) -> Val:
    out = _cardinality(v, "<= 1", "FORG0003")
    return replace(out, sql=f"try_element_at({out.sql}, 1)", seq=False)


@function("one-or-more", 1)
def one_or_more(v: Val) -> Val:
    return _cardinality(v, ">= 1", "FORG0004")


@function("exactly-one", 1)
def exactly_one(v: Val) -> Val:
    out = _cardinality(v, "= 1", "FORG0005")
    return replace(out, sql=f"try_element_at({out.sql}, 1)", seq=False)


@function("distinct-values", 1, 2)
def distinct_values(v: Val, *rest: Val) -> Val:
    """First occurrences; NaN equals itself."""
    if v.type == "empty":
        return v
    return replace(v, sql=f"array_distinct({items_of(v)})", seq=True, node=False)


@function("index-of", 2, 3)
def index_of(v: Val, target: Val, *rest: Val) -> Val:
    collation(*rest)
    i, x = fresh("i"), fresh()
    same = general_compare("eq", replace(v, sql=x, seq=False), target).sql
    found = f"filter(transform({items_of(v)}, ({x}, {i}) -> if({same}, cast({i} + 1 as bigint), null)), {x} -> {x} is not null)"
    return Val(found, "integer", seq=True)


@function("remove", 2)
def remove(v: Val, place: Val) -> Val:
    x, i = fresh(), fresh("i")
    return replace(v, sql=f"filter({items_of(v)}, ({x}, {i}) -> {i} + 1 <> {cast(place, 'integer').sql})", seq=True)


def together(vals: list[Val]) -> Val:
    """Values one after another as a sequence of their common type."""
    from treequill.functions.values import as_text, common

    kind = common(vals)
    if kind == "empty":
        return EMPTY
    parts = []
    for v in vals:
        if v.type == "empty":
            continue
        if v.type != kind:
            v = cast_items(v, kind) if kind in NUMERIC else Val(f"transform({v.sql}, t -> {as_text(Val('t', v.type))})", kind, seq=True) if v.seq else Val(as_text(v), kind)
        parts.append(items_of(v))
    return Val(parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})", kind, seq=True, node=all(v.node for v in vals if v.type != "empty"))


@function("insert-before", 3)
def insert_before(v: Val, place: Val, new: Val) -> Val:
    if new.type == "empty":
        return v
    if v.type == "empty":
        return new
    a = fresh()
    whole = Val(a, v.type, seq=True, node=v.node)
    at = f"least(greatest({cast(place, 'integer').sql}, 1L), size({a}) + 1L)"
    front = replace(whole, sql=f"slice({a}, 1, cast({at} - 1 as int))")
    back = replace(whole, sql=f"slice({a}, cast({at} as int), size({a}) + 1)")
    out = together([front, new, back])
    return replace(out, sql=f"element_at(transform(array({items_of(v)}), {a} -> {out.sql}), 1)")


@function("subsequence", 2, 3)
def subsequence(v: Val, start: Val, length: Val | None = None) -> Val:
    x, i = fresh(), fresh("i")
    first = f"floor({cast(start, 'double').sql} + 0.5D)"
    test = f"{i} + 1 >= {first}"
    if length is not None:
        test += f" and {i} + 1 < {first} + floor({cast(length, 'double').sql} + 0.5D)"
    return replace(v, sql=f"filter({items_of(v)}, ({x}, {i}) -> {test})", seq=True)


@function("deep-equal", 2, 3)
def deep_equal(a: Val, b: Val, *rest: Val) -> Val:
    """Equal lengths and equal items, place by place; what can't be compared differs, NaN equals itself."""
    collation(*rest)
    if a.type == "empty" or b.type == "empty":
        return boolean(f"({size(a)} = 0 and {size(b)} = 0)")
    x, y = fresh(), fresh()
    left, right = replace(a, sql=x, seq=False), replace(b, sql=y, seq=False)
    try:
        same = compare("eq", left, right)
    except XPathError:
        same = "false"
    if a.type in ("float", "double") and b.type in ("float", "double"):
        same = f"({same} or isnan({x}) and isnan({y}))"
    return boolean(f"(size({items_of(a)}) = size({items_of(b)}) and forall(zip_with({items_of(a)}, {items_of(b)}, ({x}, {y}) -> coalesce({same}, false)), z -> z))")


# Aggregates over a sequence in the row. Over a path they are SQL aggregates (see the compiler).


def summable(v: Val) -> Val:
    """The sequence with untyped items as doubles and integers as decimals."""
    if v.type == "untyped":
        v = cast_items(v, "double")
    if v.type == "integer":
        v = cast_items(v, "decimal")
    if v.type not in (*NUMERIC, "yearMonth", "dayTime", "empty"):
        raise XPathError("FORG0006", f"no sum of {v.type}")
    return v


def _total(v: Val) -> str:
    a, x = fresh("a"), fresh()
    return f"aggregate({items_of(v)}, cast(0 as {SQL_OF[v.type]}), ({a}, {x}) -> cast({a} + {x} as {SQL_OF[v.type]}))"


@function("sum", 1, 2)
def sum_(v: Val, zero: Val | None = None) -> Val:
    if v.type == "empty":
        return Val("cast(0 as bigint)", "integer") if zero is None else zero
    v = summable(v)
    out = Val(_total(v), v.type)
    if zero is None:
        return out
    other = zero.sql if zero.type == v.type else f"cast({zero.sql} as {SQL_OF[v.type]})" if zero.type != "empty" else "null"
    return replace(out, sql=f"if({size(v)} = 0, {other}, {out.sql})")


@function("avg", 1)
def avg(v: Val) -> Val:
    if v.type == "empty":
        return EMPTY
    v = summable(v)
    mean = arithmetic("div", Val(_total(v), v.type), integer(size(v)))
    return replace(mean, sql=f"if({size(v)} = 0, null, {mean.sql})")


def _extreme(v: Val, name: str) -> Val:
    if v.type == "empty":
        return EMPTY
    if v.type == "untyped":
        v = cast_items(v, "double")
    if v.type not in (*NUMERIC, *TEXTUAL, "yearMonth", "dayTime"):
        raise XPathError("FORG0006", f"no {name} of {v.type}")
    out = f"array_{name}({items_of(v)})"
    if v.type in ("float", "double") and name == "min":
        out = f"if(isnan(array_max({items_of(v)})), cast('NaN' as {v.type}), {out})"
    return Val(out, v.type)


@function("min", 1, 2)
def min_(v: Val, *rest: Val) -> Val:
    return _extreme(v, "min")


@function("max", 1, 2)
def max_(v: Val, *rest: Val) -> Val:
    return _extreme(v, "max")


