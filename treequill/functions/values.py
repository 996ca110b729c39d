"""Typed SQL expressions: what an XPath value is in a plan, and casts, comparisons and arithmetic on it.

A value is an item or nothing (SQL null), or a sequence of items (a SQL array
without nulls). Its XPath type is static. Times carry their offset beside their
local value, durations keep months and seconds apart.
"""

from __future__ import annotations

import itertools
import re
from dataclasses import dataclass, replace
from datetime import date, datetime
from decimal import Decimal

from treequill.types import lexical
from treequill.xpath.errors import XPathError

#: Numeric types by promotion.
NUMERIC = ("integer", "decimal", "float", "double")
TEXTUAL = ("string", "untyped", "anyURI")
TEMPORAL = ("dateTime", "date", "time")
DURATIONS = ("yearMonth", "dayTime", "duration")
SQL_OF = {
    "integer": "bigint", "decimal": "decimal(38, 18)", "float": "float", "double": "double", "string": "string", "untyped": "string", "anyURI": "string", "boolean": "boolean",
    "date": "date", "dateTime": "timestamp_ntz", "time": "decimal(14, 6)", "yearMonth": "bigint", "dayTime": "decimal(28, 6)", "duration": "bigint", "empty": "string",
}
#: xs: names of the types above.
XS = {"untyped": "untypedAtomic", "yearMonth": "yearMonthDuration", "dayTime": "dayTimeDuration"}
OF_XS = {v: k for k, v in XS.items()}
_fresh = itertools.count(1)


def fresh(stem: str = "x") -> str:
    return f"{stem}_{next(_fresh)}"


@dataclass(frozen=True)
class Val:
    sql: str
    type: str
    seq: bool = False
    #: A node's typed value: its effective boolean value is its existence.
    node: bool = False
    #: Offset from UTC in minutes, of temporal types.
    tz: str | None = None
    #: Seconds, of xs:duration.
    secs: str | None = None
    #: The value, if it is a literal.
    const: object = None
    #: Of a node of a validated document: SQL of whether its type is a number's.
    numeric: str | None = None
    #: Of a sequence of such: SQL of an array of structs of each value, v, and whether its type is a number's, n.
    typed: str | None = None
    #: Of a boolean: SQL that is true where the value is, but may be null where it is false. Joins and pushed filters see its parts.
    bare: str | None = None


EMPTY = Val("cast(null as string)", "empty")


def text_literal(text: str) -> str:
    escaped = text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f"'{escaped}'"


def of_literal(value: object, kind: str) -> Val:
    if kind == "string":
        sql = text_literal(str(value))
    elif kind == "integer":
        sql = f"{value}L" if abs(int(value)) < 2**63 else f"cast('{value}' as bigint)"  # type: ignore[call-overload]
    elif kind == "decimal":
        sql = f"cast('{value}' as decimal(38, 18))"
    elif kind == "double":
        sql = f"cast('{'Infinity' if value == float('inf') else repr(value)}' as double)"
    else:
        sql = "true" if value else "false"
    return Val(sql, kind, const=value)


def error(code: str, why: str) -> str:
    return f"raise_error('{code}: {why}')"


def boolean(sql: str) -> Val:
    return Val(sql, "boolean")


def string(sql: str) -> Val:
    return Val(sql, "string")


def integer(sql: str) -> Val:
    return Val(sql, "integer")


def items_of(v: Val) -> str:
    """The value as an array."""
    if v.seq:
        return v.sql
    if v.type == "empty":
        return "array()"
    return f"array_compact(array({v.sql}))"


def one(v: Val, what: str = "a value") -> Val:
    """The value as an item or nothing: XPTY0004 on more items."""
    if not v.seq:
        return v
    name = fresh()
    picked = f"element_at(transform(array({v.sql}), {name} -> case when size({name}) > 1 then {error('XPTY0004', 'more than one item for ' + what)} else try_element_at({name}, 1) end), 1)"
    return replace(v, sql=picked, seq=False, typed=None)


def first(v: Val) -> Val:
    return replace(v, sql=f"try_element_at({v.sql}, 1)", seq=False) if v.seq else v


# Text and numbers of a value.


def as_text(v: Val) -> str:
    """SQL of the item's string value by the casting rules; null where there is none."""
    v = one(v, "a string")
    if v.type in TEXTUAL or v.type == "empty":
        return v.sql
    if v.type in ("float", "double"):
        # Numbers of ordinary size have no exponent, whole ones no point.
        plain = _decimal_text(f"cast(cast({v.sql} as string) as decimal(38, 18))")
        scientific = f"cast({v.sql} as string)"
        infinite = "cast('Infinity' as double)"
        return (
            f"case when {v.sql} is null then null when isnan({v.sql}) then 'NaN' when {v.sql} = {infinite} then 'INF' when {v.sql} = -{infinite} then '-INF' "
            f"when {v.sql} = 0 then '0' when abs({v.sql}) >= 1e-6 and abs({v.sql}) < 1e6 then {plain} else {scientific} end"
        )
    if v.type == "decimal":
        return _decimal_text(v.sql)
    if v.type in ("integer", "boolean"):
        return f"cast({v.sql} as string)"
    if v.type in TEMPORAL:
        return _temporal_text(v)
    if v.type in DURATIONS:
        return _duration_text(v)
    if v.type == "QName":
        return f"concat_ws(':', nullif({v.sql}.prefix, ''), {v.sql}.local)"
    return f"cast({v.sql} as string)"


def canonical_text(v: Val) -> str:
    """The item's text; of a node whose type is a number's the number's, so that equal values have equal texts."""
    v = one(v, "a string")
    if not v.numeric:
        return as_text(v)
    number = f"try_cast(btrim({v.sql}, ' \\t\\n\\r') as decimal(38, 18))"
    return f"if({v.numeric}, coalesce({_decimal_text(number)}, {v.sql}), {v.sql})"


def typed_items(sql: str) -> Val:
    """The values of an array of structs of node values, v, and whether their types are numbers', n."""
    x = fresh()
    return Val(f"transform({sql}, {x} -> {canonical_text(_typed(x))})", "untyped", seq=True, node=True, typed=sql)


def _typed(x: str) -> Val:
    return Val(f"{x}.v", "untyped", node=True, numeric=f"{x}.n")


def _decimal_text(sql: str) -> str:
    """A decimal without closing zeros."""
    return f"case when {sql} = 0 then '0' else trim(TRAILING '.' FROM trim(TRAILING '0' FROM cast(cast({sql} as decimal(38, 18)) as string))) end"


def _offset_text(tz: str | None) -> str:
    if tz is None:
        return "''"
    size = f"abs({tz})"
    return f"case when {tz} is null then '' when {tz} = 0 then 'Z' else concat(if({tz} < 0, '-', '+'), lpad(cast({size} div 60 as string), 2, '0'), ':', lpad(cast({size} % 60 as string), 2, '0')) end"


def _temporal_text(v: Val) -> str:
    tail = _offset_text(v.tz)
    if v.type == "date":
        return f"concat(date_format({v.sql}, 'yyyy-MM-dd'), {tail})"
    if v.type == "dateTime":
        fraction = f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM date_format({v.sql}, '.SSSSSS')))"
        return f"concat(date_format({v.sql}, \"yyyy-MM-dd'T'HH:mm:ss\"), {fraction}, {tail})"
    whole = f"cast(floor({v.sql}) as bigint)"
    parts = [f"lpad(cast({whole} div 3600 as string), 2, '0')", f"lpad(cast({whole} div 60 % 60 as string), 2, '0')", f"lpad(cast({whole} % 60 as string), 2, '0')"]
    fraction = f"trim(TRAILING '.' FROM trim(TRAILING '0' FROM substr(cast(cast({v.sql} % 1 as decimal(7, 6)) as string), 2)))"
    return f"concat(concat_ws(':', {', '.join(parts)}), {fraction}, {tail})"


def _duration_text(v: Val) -> str:
    months = v.sql if v.type != "dayTime" else "0L"
    secs = v.sql if v.type == "dayTime" else v.secs or "cast(0 as decimal(28, 6))"
    m, s = f"abs({months})", f"abs({secs})"
    days, hours, minutes = f"cast({s} div 86400 as bigint)", f"cast({s} div 3600 % 24 as bigint)", f"cast({s} div 60 % 60 as bigint)"
    rest = f"cast({s} % 60 as decimal(8, 6))"
    part = lambda n, unit: f"if({n} = 0, '', concat(cast({n} as string), '{unit}'))"
    rest_text = f"if({rest} = 0, '', concat(trim(TRAILING '.' FROM trim(TRAILING '0' FROM cast({rest} as string))), 'S'))"
    clock = f"concat({part(hours, 'H')}, {part(minutes, 'M')}, {rest_text})"
    body = f"concat({part(f'{m} div 12', 'Y')}, {part(f'{m} % 12', 'M')}, {part(days, 'D')}, if({clock} = '', '', concat('T', {clock})))"
    zero = "'P0M'" if v.type == "yearMonth" else "'PT0S'"
    return f"case when {v.sql} is null then null when {body} = '' then {zero} else concat(if({months} < 0 or {secs} < 0, '-', ''), 'P', {body}) end"


def as_double(v: Val) -> str:
    """fn:number: NaN where there is no number."""
    v = one(v, "a number")
    nan = "cast('NaN' as double)"
    if v.type in NUMERIC:
        return f"coalesce(cast({v.sql} as double), {nan})"
    if v.type == "boolean":
        return f"coalesce(cast(cast({v.sql} as int) as double), {nan})"
    if v.type in ("string", "untyped"):
        return f"coalesce(if({lexical.valid(v.sql, 'double')}, {lexical.value(v.sql, 'double')}, null), {nan})"
    return nan


# Casts.


def _parse_tz(text: str) -> str:
    mark = f"regexp_extract({text}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', 1)"
    minutes = f"(cast(substr({mark}, 2, 2) as int) * 60 + cast(substr({mark}, 5, 2) as int)) * if(startswith({mark}, '-'), -1, 1)"
    return f"case {mark} when '' then null when 'Z' then 0 else {minutes} end"


def _parse_duration(text: str) -> tuple[str, str]:
    """SQL of the months and seconds of a valid duration text."""
    part = lambda pattern: f"coalesce(try_cast(nullif(regexp_extract({text}, '{pattern}', 1), '') as decimal(20, 6)), 0)"
    sign = f"if(startswith({text}, '-'), -1, 1)"
    months = f"cast({sign} * ({part('([0-9]+)Y')} * 12 + {part('^[^T]*?([0-9]+)M')}) as bigint)"
    secs = f"cast({sign} * ({part('([0-9]+)D')} * 86400 + {part('T.*?([0-9]+)H')} * 3600 + {part('T.*?([0-9]+)M')} * 60 + {part('([0-9.]+)S')}) as decimal(28, 6))"
    return months, secs


#: The offset of a literal without one.
_NO_OFFSET = "cast(null as int)"


def _folded(text: str, target: str) -> Val | None:
    """The cast of a literal text, so that plans compare columns with plain literals; None leaves it to the general cast, and so do invalid texts."""
    xs = XS.get(target, target)
    text = " ".join(text.split())
    if not text.isascii() or re.fullmatch(lexical.TYPES[xs].pattern, text) is None:
        return None
    if target in TEMPORAL:
        local, zone = re.fullmatch(r"(.*?)(Z|[+-]\d\d:\d\d)?", text).groups()  # type: ignore[union-attr]
        tz = _NO_OFFSET if zone is None else str(0 if zone == "Z" else (int(zone[1:3]) * 60 + int(zone[4:])) * (-1 if zone[0] == "-" else 1))
        if len(local.partition(".")[2]) > 6:
            return None
        try:
            if target == "date":
                return Val(f"date'{date.fromisoformat(local)}'", target, tz=tz)
            if target == "dateTime":
                return Val(f"timestamp_ntz'{datetime.fromisoformat(local)}'", target, tz=tz)
        except ValueError:  # years beyond four digits, and 24:00:00
            return None
        hour, minute, second = local.split(":")
        return Val(f"cast('{int(hour) % 24 * 3600 + int(minute) * 60 + Decimal(second)}' as decimal(14, 6))", target, tz=tz)
    if target in ("yearMonth", "dayTime"):
        days, _, clock = text.lstrip("-").partition("T")
        part = lambda of, unit: Decimal(m[1]) if (m := re.search(rf"([0-9.]+){unit}", of)) else Decimal(0)
        sign = -1 if text.startswith("-") else 1
        if target == "yearMonth":
            return Val(f"cast('{sign * int(part(days, 'Y') * 12 + part(days, 'M'))}' as bigint)", target)
        return Val(f"cast('{sign * (part(days, 'D') * 86400 + part(clock, 'H') * 3600 + part(clock, 'M') * 60 + part(clock, 'S'))}' as decimal(28, 6))", target)
    if target == "integer" and abs(int(text)) < 2**63 and lexical.TYPES[xs].low is None:
        return Val(f"{int(text)}L", target)
    return None


def _from_text(v: Val, target: str, safe: bool) -> Val:
    xs = XS.get(target, target)
    if xs not in lexical.TYPES:
        raise XPathError("XPST0051", f"no cast to {target}")
    if isinstance(v.const, str) and (found := _folded(v.const, target)) is not None:
        return found
    name = fresh("s")
    text = lexical.normalized(name, "collapse")
    bad = "null" if safe else error("FORG0001", f"no xs:{xs}")

    def bound(body: str) -> str:
        """``body`` over the text, which is computed once."""
        return f"element_at(transform(array({v.sql}), {name} -> case when {name} is null then null when {lexical.valid(name, xs)} then {body} else {bad} end), 1)"

    if target in TEMPORAL:
        plain = f"regexp_replace({text}, '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$', '')"
        if target == "time":
            bits = [f"cast(substr({text}, {i}, 2) as int)" for i in (1, 4)]
            local = f"cast(({bits[0]} % 24) * 3600 + {bits[1]} * 60 + cast(substr({plain}, 7) as decimal(10, 6)) as decimal(14, 6))"
        elif target == "date":
            local = f"cast({plain} as date)"
        else:
            midnight = f"cast(date_add(cast(substr({plain}, 1, 10) as date), 1) as timestamp_ntz)"
            local = f"case when {plain} like '%T24:%' then {midnight} else cast({plain} as timestamp_ntz) end"
        return Val(bound(local), target, tz=bound(_parse_tz(text)))
    if target in DURATIONS:
        months, secs = (bound(x) for x in _parse_duration(text))
        return Val(secs if target == "dayTime" else months, target, secs=secs if target == "duration" else None)
    value = lexical.value(name, xs)
    if target == "integer":
        value = f"cast({lexical.value(name, 'integer')} as bigint)"
    return Val(bound(value), target)


def cast(v: Val, target: str, safe: bool = False) -> Val:
    """The item cast to a type. FORG0001 (null, if ``safe``) where a text is in no lexical space; XPTY0004 where no cast exists."""
    v = one(v, "a cast")
    if target in ("string", "untyped", "anyURI"):
        return Val(as_text(v), target)
    if v.type == "empty":
        return Val(f"cast(null as {SQL_OF.get(target, 'string')})", target)
    if target == v.type:
        return replace(v, node=False, const=None)
    if v.type in ("string", "untyped"):
        return _from_text(v, target, safe)
    if target in NUMERIC and (v.type in NUMERIC or v.type == "boolean"):
        sql = f"cast({v.sql} as int)" if v.type == "boolean" else v.sql
        if target in ("integer", "decimal") and v.type in ("float", "double"):
            bad = "null" if safe else error("FOCA0002", "no finite number")
            kind = SQL_OF[target]
            return Val(f"case when isnan({sql}) or abs({sql}) = cast('Infinity' as double) then {bad} else {'try_cast' if safe else 'cast'}({sql} as {kind}) end", target)
        return Val(f"cast({sql} as {SQL_OF[target]})", target)
    if target == "boolean" and v.type in NUMERIC:
        return boolean(f"({v.sql} <> 0" + (f" and not isnan({v.sql})" if v.type in ("float", "double") else "") + ")")
    if target in TEMPORAL and v.type in TEMPORAL:
        if (v.type, target) == ("dateTime", "date"):
            return Val(f"cast({v.sql} as date)", target, tz=v.tz)
        if (v.type, target) == ("date", "dateTime"):
            return Val(f"cast({v.sql} as timestamp_ntz)", target, tz=v.tz)
        if (v.type, target) == ("dateTime", "time"):
            return Val(f"cast(hour({v.sql}) * 3600 + minute({v.sql}) * 60 + extract(SECOND FROM {v.sql}) as decimal(14, 6))", target, tz=v.tz)
    if target in DURATIONS and v.type in DURATIONS:
        months = v.sql if v.type != "dayTime" else f"if({v.sql} is null, null, 0L)"
        secs = v.sql if v.type == "dayTime" else v.secs or f"if({v.sql} is null, null, cast(0 as decimal(28, 6)))"
        return Val(secs if target == "dayTime" else months, target, secs=secs if target == "duration" else None)
    if {v.type, target} == {"hexBinary", "base64Binary"}:
        return Val(v.sql, target)
    raise XPathError("XPTY0004", f"no cast from {v.type} to {target}")


def castable(v: Val, target: str) -> Val:
    try:
        return boolean(f"({cast(v, target, True).sql} is not null)")
    except XPathError:
        return boolean("false")


# Effective boolean value.


def ebv(v: Val) -> str:
    """SQL of the effective boolean value; never null."""
    if v.node:
        return f"(size({v.sql}) > 0)" if v.seq else f"({v.sql} is not null)"
    if v.type == "empty":
        return "false"
    if v.seq:
        name = fresh()
        single = ebv(replace(v, sql=f"try_element_at({name}, 1)", seq=False))
        return f"element_at(transform(array({v.sql}), {name} -> case when size({name}) > 1 then {error('FORG0006', 'no boolean value of many items')} else {single} end), 1)"
    if v.type == "boolean":
        return f"coalesce({v.sql}, false)"
    if v.type in TEXTUAL:
        return f"coalesce(length({v.sql}) > 0, false)"
    if v.type in NUMERIC:
        nan = f" and not isnan({v.sql})" if v.type in ("float", "double") else ""
        return f"coalesce({v.sql} <> 0{nan}, false)"
    raise XPathError("FORG0006", f"no boolean value of {v.type}")


def truth(v: Val) -> str:
    """SQL for a WHERE clause, which takes null for false."""
    if v.type == "boolean" and not v.seq and not v.node:
        return v.bare or v.sql
    return ebv(v)


# Comparison.

_OPS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
GENERAL = {"=": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge"}


def _instant(v: Val, other: Val) -> str:
    """A temporal value in UTC; without an offset it is in UTC already. A column without offsets stays bare, for filters that are pushed down."""
    if v.tz in (None, _NO_OFFSET, "0"):
        return v.sql
    tz = f"coalesce({v.tz}, 0)" if v.tz else "0"
    if v.type == "time":
        return f"({v.sql} - {tz} * 60)"
    return f"timestampadd(MINUTE, -({tz}), cast({v.sql} as timestamp_ntz))"


def compare(op: str, a: Val, b: Val) -> str:
    """SQL of a value comparison of two items; null if either is missing."""
    sign = _OPS[op]
    if a.type == "empty" or b.type == "empty":
        return "cast(null as boolean)"
    if a.type in NUMERIC and b.type in NUMERIC:
        base = f"({a.sql} {sign} {b.sql})"
        floats = [v.sql for v in (a, b) if v.type in ("float", "double")]
        if not floats:
            return base
        nans = " or ".join(f"isnan({x})" for x in floats)
        return f"({base} or {nans})" if op == "ne" else f"({base} and not ({nans}))"
    if a.type in TEXTUAL and b.type in TEXTUAL or a.type == b.type == "boolean":
        return f"({a.sql} {sign} {b.sql})"
    if a.type == b.type and a.type in TEMPORAL:
        return f"({_instant(a, b)} {sign} {_instant(b, a)})"
    if a.type in DURATIONS and b.type in DURATIONS:
        if a.type == b.type != "duration":
            return f"({a.sql} {sign} {b.sql})"
        if op in ("eq", "ne"):
            x, y = cast(a, "duration"), cast(b, "duration")
            same = f"({x.sql} = {y.sql} and {x.secs} = {y.secs})"
            return same if op == "eq" else f"(not {same})"
    if a.type == b.type == "QName" and op in ("eq", "ne"):
        same = f"({a.sql}.ns <=> {b.sql}.ns and {a.sql}.local = {b.sql}.local)"
        return same if op == "eq" else f"(not {same})"
    if a.type == b.type and a.type not in SQL_OF and op in ("eq", "ne"):
        return f"({a.sql} {sign} {b.sql})"
    raise XPathError("XPTY0004", f"no {op} between {a.type} and {b.type}")


def value_compare(op: str, a: Val, b: Val) -> Val:
    a, b = one(a, op), one(b, op)
    if a.numeric and b.numeric:
        return boolean(_pair(op, a, b))
    a, b = (cast(x, "double", True) if x.numeric and y.type in NUMERIC else replace(x, type="string") if x.type == "untyped" else x for x, y in ((a, b), (b, a)))
    return boolean(compare(op, a, b))


def _pair(op: str, a: Val, b: Val) -> str:
    """One pair of a general comparison: untyped operands take the other's type, and what has no operator doesn't match.

    Neither does untyped text that isn't in the other's lexical space: Spark may
    test a comparison on nodes that another condition rules out, so it can't raise.
    """
    if a.type == b.type == "untyped" and a.numeric and b.numeric:
        values = compare(op, cast(a, "double", True), cast(b, "double", True))
        return f"(case when {a.numeric} and {b.numeric} then {values} else {compare(op, a, b)} end)"
    a, b = _alike(a, b)
    try:
        return compare(op, a, b)
    except XPathError:
        return "false"


def _alike(a: Val, b: Val) -> tuple[Val, Val]:
    """A pair with untyped operands in the other's type; null is what isn't in its lexical space."""
    if a.type == "untyped" and b.type != "untyped":
        return cast(a, "double" if b.type in NUMERIC else "string" if b.type in TEXTUAL else b.type, True), b
    if b.type == "untyped" and a.type != "untyped":
        return a, cast(b, "double" if a.type in NUMERIC else "string" if a.type in TEXTUAL else a.type, True)
    return a, b


def unequal(a: Val, b: Val) -> tuple[str, tuple[str, str]] | None:
    """What makes ``a != b`` false, of single items: SQL of their equality, and of the sides that may be null. None where a null has more than one cause, or NaN is compared."""
    a, b = _alike(a, b)
    plain = a.type == b.type and a.type in (*TEXTUAL, "integer", "decimal", "boolean") or {a.type, b.type} <= {"integer", "decimal"} or a.type in TEXTUAL and b.type in TEXTUAL
    return (compare("eq", a, b), (a.sql, b.sql)) if plain else None


def general_compare(op: str, a: Val, b: Val) -> Val:
    """Is there a pair of items that compares so? Orders against a sequence need its least or greatest item only."""
    if a.type == "empty" or b.type == "empty":
        return boolean("false")
    if not a.seq and not b.seq:
        bare = _pair(op, a, b)
        return Val(f"coalesce({bare}, false)", "boolean", bare=bare)
    x, y = fresh(), fresh()
    left, right = (_typed(n) if v.typed else replace(v, sql=n, seq=False) if v.seq else v for v, n in ((a, x), (b, y)))
    body = f"coalesce({_pair(op, left, right)}, false)"
    if b.seq:
        body = f"exists({b.typed or b.sql}, {y} -> {body})"
    if a.seq:
        body = f"exists({a.typed or a.sql}, {x} -> {body})"
    return boolean(f"coalesce({body}, false)")


# Arithmetic.


def number(v: Val) -> Val:
    """An operand: untyped text becomes a double."""
    v = one(v, "arithmetic")
    return cast(v, "double") if v.type == "untyped" else v


def _wide(v: Val) -> str:
    return v.sql if v.type != "decimal" else f"cast({v.sql} as decimal(37, 18))"


def arithmetic(op: str, a: Val, b: Val) -> Val:
    a, b = number(a), number(b)
    if a.type == "empty" or b.type == "empty":
        return EMPTY
    if a.type in NUMERIC and b.type in NUMERIC:
        kind = NUMERIC[max(NUMERIC.index(a.type), NUMERIC.index(b.type))]
        zero = error("FOAR0001", "division by zero")
        if op in "+-*":
            if kind == "decimal":
                if op == "*":
                    # Operands of 9 places and few digits multiply without loss; larger ones keep 6 places.
                    small = f"cast(try_cast({a.sql} as decimal(20, 9)) * try_cast({b.sql} as decimal(18, 9)) as decimal(38, 18))"
                    large = f"cast(cast({a.sql} as decimal(27, 9)) * cast({b.sql} as decimal(27, 9)) as decimal(38, 18))"
                    return Val(f"coalesce({small}, {large})", kind)
                x, y = (f"cast({v.sql} as decimal(37, 18))" for v in (a, b))
                return Val(f"cast({x} {op} {y} as decimal(38, 18))", kind)
            return Val(f"cast({a.sql} {op} {b.sql} as {SQL_OF[kind]})", kind)
        if op == "div":
            if kind in ("integer", "decimal"):
                x = f"cast({a.sql} as decimal({'19, 0' if a.type == 'integer' else '38, 18'}))"
                y = f"cast({b.sql} as decimal({'18, 0' if b.type == 'integer' else '20, 9'}))"
                return Val(f"case when {b.sql} = 0 then {zero} else cast({x} / {y} as decimal(38, 18)) end", "decimal")
            x, y = f"cast({a.sql} as double)", f"cast({b.sql} as double)"
            special = f"case when {x} = 0 or isnan({x}) then cast('NaN' as double) when {x} > 0 then cast('Infinity' as double) else cast('-Infinity' as double) end"
            return Val(f"cast(case when {y} = 0 then {special} else try_divide({x}, {y}) end as {SQL_OF[kind]})", kind)
        if op == "idiv":
            if kind in ("integer", "decimal"):
                return integer(f"case when {b.sql} = 0 then {zero} else cast({_wide(a)} div {_wide(b)} as bigint) end")
            bad = f"{b.sql} = 0 or isnan({a.sql}) or isnan({b.sql}) or abs({a.sql}) = cast('Infinity' as double)"
            return integer(f"case when {bad} then {zero} else cast(try_divide(cast({a.sql} as double), cast({b.sql} as double)) as bigint) end")
        if op == "mod":
            if kind in ("integer", "decimal"):
                return Val(f"case when {b.sql} = 0 then {zero} else cast({_wide(a)} % {_wide(b)} as {SQL_OF[kind]}) end", kind)
            x, y = f"cast({a.sql} as double)", f"cast({b.sql} as double)"
            return Val(f"cast(case when {y} = 0 then cast('NaN' as double) when abs({y}) = cast('Infinity' as double) then {x} else {x} % {y} end as {SQL_OF[kind]})", kind)
    out = _temporal(op, a, b)
    if out is None:
        raise XPathError("XPTY0004", f"no {op} between {a.type} and {b.type}")
    return out


def shift(v: Val, months: str | None, secs: str | None, sign: str) -> Val:
    """A temporal value moved by months (clamped to the month's end) and seconds."""
    if v.type == "time":
        moved = f"({v.sql} {sign} {secs or 0}) % 86400"
        return replace(v, sql=f"cast(({moved} + 86400) % 86400 as decimal(14, 6))", node=False)
    local = f"cast({v.sql} as timestamp_ntz)"
    if months is not None:
        day = f"add_months(cast({v.sql} as date), cast({sign}({months}) as int))"
        local = f"timestampadd(MICROSECOND, timestampdiff(MICROSECOND, cast(cast({v.sql} as date) as timestamp_ntz), {local}), cast({day} as timestamp_ntz))"
    if secs is not None:
        local = f"timestampadd(MICROSECOND, cast({sign}({secs}) * 1000000 as bigint), {local})"
    return replace(v, sql=f"cast({local} as {SQL_OF[v.type]})", node=False)


def _temporal(op: str, a: Val, b: Val) -> Val | None:
    kinds = (a.type, b.type)
    if op in "+-":
        if op == "+" and a.type in ("yearMonth", "dayTime") and b.type in TEMPORAL:
            a, b = b, a
        if a.type in TEMPORAL and b.type == "yearMonth" and a.type != "time":
            return shift(a, b.sql, None, op)
        if a.type in TEMPORAL and b.type == "dayTime":
            return shift(a, None, b.sql, op)
        if op == "-" and a.type == b.type and a.type in TEMPORAL:
            x, y = _instant(a, b), _instant(b, a)
            if a.type == "time":
                return Val(f"cast({x} - {y} as decimal(28, 6))", "dayTime")
            return Val(f"cast(timestampdiff(MICROSECOND, cast({y} as timestamp_ntz), cast({x} as timestamp_ntz)) as decimal(28, 6)) / 1000000", "dayTime")
        if a.type == b.type and a.type in ("yearMonth", "dayTime"):
            return Val(f"cast({a.sql} {op} {b.sql} as {SQL_OF[a.type]})", a.type)
    if op == "*" and a.type in NUMERIC and b.type in ("yearMonth", "dayTime"):
        a, b = b, a
    if op in ("*", "div") and a.type in ("yearMonth", "dayTime") and b.type in NUMERIC:
        sign = "*" if op == "*" else "/"
        exact = f"cast({a.sql} as double) {sign} nullif(cast({b.sql} as double), 0)" if op == "div" else f"cast({a.sql} as double) * cast({b.sql} as double)"
        return Val(f"cast(floor({exact} + 0.5) as bigint)" if a.type == "yearMonth" else f"cast({exact} as decimal(28, 6))", a.type)
    if op == "div" and kinds in (("yearMonth", "yearMonth"), ("dayTime", "dayTime")):
        return Val(f"case when {b.sql} = 0 then {error('FOAR0001', 'division by zero')} else cast(cast({a.sql} as decimal(20, 6)) / cast({b.sql} as decimal(20, 6)) as decimal(38, 18)) end", "decimal")
    return None


def negative(v: Val) -> Val:
    v = number(v)
    if v.type == "empty":
        return EMPTY
    if v.type not in NUMERIC:
        raise XPathError("XPTY0004", f"no sign of {v.type}")
    const = -v.const if isinstance(v.const, int | float | Decimal) and not isinstance(v.const, bool) else None
    return Val(f"(-{v.sql})", v.type, const=const)


def common(vals: list[Val]) -> str:
    """The type that the items of several values get in one sequence."""
    kinds = [v.type for v in vals if v.type != "empty"]
    if not kinds:
        return "empty"
    if len(set(kinds)) == 1:
        return kinds[0]
    if all(k in NUMERIC for k in kinds):
        return NUMERIC[max(map(NUMERIC.index, kinds))]
    if all(k in TEXTUAL for k in kinds):
        return "string" if "string" in kinds else kinds[0]
    return "string"
