"""The built-in simple types: white space, lexical space, bounds, base type and SQL value.

Everything is a SQL text over a string column, so that Catalyst sees plain
predicates. Spark's casts accept more than XML Schema does (``1e3`` as a decimal,
``yes`` as a boolean, dates without leading zeros), so a cast always stands
behind its type's pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from treequill.types.regex import literal

#: XML Schema's white space: exactly these four characters.
SPACES = "' \\t\\n\\r'"

_TZ = r"(Z|[+-](0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_YEAR = r"-?([1-9]\d{3,}|0\d{3})"
_MONTH, _DAY = r"(0[1-9]|1[0-2])", r"(0[1-9]|[12]\d|3[01])"
_CLOCK = r"(([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d+)?|24:00:00(\.0+)?)"
_START = r"[:_\p{L}]"
_CHAR = r"[\-.:_\p{L}\p{N}\p{M}\x{B7}]"
_NC_START, _NC_CHAR = r"[_\p{L}]", r"[\-._\p{L}\p{N}\p{M}\x{B7}]"
_INT = r"[+-]?\d+"
_FLOAT = r"([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)"
_DAYS = r"(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?"
_NCNAME = f"{_NC_START}{_NC_CHAR}*"


@dataclass(frozen=True)
class SimpleType:
    name: str
    base: str
    primitive: str
    #: preserve, replace or collapse.
    space: str = "collapse"
    #: Java pattern of the whole collapsed text.
    pattern: str = r"(?s).*"
    low: int | None = None
    high: int | None = None
    #: The type of a list's items.
    item: str | None = None


_BITS = {"long": 63, "int": 31, "short": 15, "byte": 7}
_UNSIGNED = {"unsignedLong": 64, "unsignedInt": 32, "unsignedShort": 16, "unsignedByte": 8}


def _types() -> dict[str, SimpleType]:
    out = [
        SimpleType("string", "anyAtomicType", "string", "preserve"),
        SimpleType("normalizedString", "string", "string", "replace"),
        SimpleType("token", "normalizedString", "string"),
        SimpleType("language", "token", "string", pattern=r"[a-zA-Z]{1,8}(-[a-zA-Z0-9]{1,8})*"),
        SimpleType("NMTOKEN", "token", "string", pattern=f"{_CHAR}+"),
        SimpleType("Name", "token", "string", pattern=f"{_START}{_CHAR}*"),
        *[SimpleType(n, b, "string", pattern=_NCNAME) for n, b in (("NCName", "Name"), ("ID", "NCName"), ("IDREF", "NCName"), ("ENTITY", "NCName"))],
        SimpleType("boolean", "anyAtomicType", "boolean", pattern="true|false|1|0"),
        SimpleType("decimal", "anyAtomicType", "decimal", pattern=r"[+-]?(\d+(\.\d*)?|\.\d+)"),
        SimpleType("integer", "decimal", "decimal", pattern=_INT),
        SimpleType("nonNegativeInteger", "integer", "decimal", pattern=_INT, low=0),
        SimpleType("positiveInteger", "nonNegativeInteger", "decimal", pattern=_INT, low=1),
        SimpleType("nonPositiveInteger", "integer", "decimal", pattern=_INT, high=0),
        SimpleType("negativeInteger", "nonPositiveInteger", "decimal", pattern=_INT, high=-1),
        *[SimpleType(n, b, "decimal", pattern=_INT, low=-(1 << _BITS[n]), high=(1 << _BITS[n]) - 1) for n, b in zip(_BITS, ["integer", *_BITS], strict=False)],
        *[SimpleType(n, b, "decimal", pattern=_INT, low=0, high=(1 << _UNSIGNED[n]) - 1) for n, b in zip(_UNSIGNED, ["nonNegativeInteger", *_UNSIGNED], strict=False)],
        SimpleType("float", "anyAtomicType", "float", pattern=_FLOAT),
        SimpleType("double", "anyAtomicType", "double", pattern=_FLOAT),
        SimpleType("duration", "anyAtomicType", "duration", pattern=rf"-?P(?=[\dT])(\d+Y)?(\d+M)?{_DAYS}"),
        SimpleType("yearMonthDuration", "duration", "duration", pattern=r"-?P(?=\d)(\d+Y)?(\d+M)?"),
        SimpleType("dayTimeDuration", "duration", "duration", pattern=rf"-?P(?=[\dT]){_DAYS}"),
        SimpleType("dateTime", "anyAtomicType", "dateTime", pattern=f"{_YEAR}-{_MONTH}-{_DAY}T{_CLOCK}{_TZ}"),
        SimpleType("dateTimeStamp", "dateTime", "dateTime", pattern=f"{_YEAR}-{_MONTH}-{_DAY}T{_CLOCK}{_TZ[:-1]}"),
        SimpleType("date", "anyAtomicType", "date", pattern=f"{_YEAR}-{_MONTH}-{_DAY}{_TZ}"),
        SimpleType("time", "anyAtomicType", "time", pattern=_CLOCK + _TZ),
        SimpleType("gYearMonth", "anyAtomicType", "gYearMonth", pattern=f"{_YEAR}-{_MONTH}{_TZ}"),
        SimpleType("gYear", "anyAtomicType", "gYear", pattern=_YEAR + _TZ),
        SimpleType("gMonthDay", "anyAtomicType", "gMonthDay", pattern=f"--(?!02-3|(0[469]|11)-31){_MONTH}-{_DAY}{_TZ}"),
        SimpleType("gDay", "anyAtomicType", "gDay", pattern=f"---{_DAY}{_TZ}"),
        SimpleType("gMonth", "anyAtomicType", "gMonth", pattern=f"--{_MONTH}{_TZ}"),
        SimpleType("hexBinary", "anyAtomicType", "hexBinary", pattern="([0-9a-fA-F]{2})*"),
        SimpleType("base64Binary", "anyAtomicType", "base64Binary", pattern=r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?"),
        SimpleType("anyURI", "anyAtomicType", "anyURI", pattern=r"(?!.*%(?![0-9a-fA-F]{2}))(?!.*#.*#)[^\x00-\x1F]*"),
        *[SimpleType(n, "anyAtomicType", n, pattern=f"({_NCNAME}:)?{_NCNAME}") for n in ("QName", "NOTATION")],
        *[SimpleType(n + "S", "anySimpleType", "list", item=n) for n in ("NMTOKEN", "IDREF")],
        SimpleType("ENTITIES", "anySimpleType", "list", item="ENTITY"),
        SimpleType("anySimpleType", "anyType", "string", "preserve"),
        SimpleType("anyAtomicType", "anySimpleType", "string", "preserve"),
        SimpleType("untypedAtomic", "anyAtomicType", "string", "preserve"),
    ]
    return {t.name: t for t in out}


TYPES = _types()


def derives(name: str, base: str) -> bool:
    """Is the built-in type ``name`` the type ``base`` or derived from it?"""
    while name in TYPES:
        if name == base:
            return True
        name = TYPES[name].base
    return name == base


def normalized(text: str, space: str) -> str:
    """SQL of a text after white-space processing."""
    if space == "preserve":
        return text
    spaces = f"translate({text}, '\\t\\n\\r', '   ')"
    return spaces if space == "replace" else f"btrim(regexp_replace({spaces}, ' +', ' '), ' ')"


def _real_date(text: str) -> str:
    """SQL: does the date in front of a text exist? Its month and day are in range already."""
    year, month, day = (f"cast(regexp_extract({text}, '^(-?[0-9]+)-([0-9]{{2}})-([0-9]{{2}})', {i}) as int)" for i in (1, 2, 3))
    leap = f"({year} % 4 = 0 and ({year} % 100 <> 0 or {year} % 400 = 0))"
    return f"{day} <= case when {month} in (4, 6, 9, 11) then 30 when {month} = 2 then case when {leap} then 29 else 28 end else 31 end"


def valid(text: str, name: str, version: str = "1.1") -> str:
    """SQL predicate: is a text, white space and all, in the lexical space of the built-in type? Null stays null."""
    kind = TYPES[name]
    if kind.item:
        items = f"split({normalized(text, 'collapse')}, ' ')"
        return f"({normalized(text, 'collapse')} <> '' and forall({items}, i -> {valid('i', kind.item, version)}))"
    value = normalized(text, kind.space)
    if kind.pattern == r"(?s).*":
        return f"({text} is not null)"
    out = f"{value} rlike {literal('^(?:' + kind.pattern + ')$(?![\\n])')}"
    if kind.low is not None or kind.high is not None:
        number = f"cast(regexp_replace({value}, '^[+]', '') as decimal(38, 0))"
        bounds = " and ".join([f"{number} >= {kind.low}"] * (kind.low is not None) + [f"{number} <= {kind.high}"] * (kind.high is not None))
        # Digits beyond Spark's 38 are judged by sign alone.
        huge = f"length(regexp_replace({value}, '^[+-]?0*', '')) > 38"
        sign = "false" if kind.low is not None and kind.high is not None else f"not startswith({value}, '-')" if kind.low is not None else f"startswith({value}, '-')"
        out = f"case when not ({out}) then false when {huge} then {sign} else {bounds} end"
    if kind.primitive in ("dateTime", "date"):
        out = f"case when not ({out}) then false else {_real_date(value)} end"
    if version == "1.0":
        if kind.primitive in ("float", "double"):
            out = f"({out} and {value} <> '+INF')"
        if kind.primitive in ("dateTime", "date", "gYear", "gYearMonth"):
            out = f"({out} and not {value} rlike '^-?0000')"
    return f"({out})"


#: Spark types of values; the others keep their collapsed text.
SQL_TYPES = {"boolean": "boolean", "decimal": "decimal(38, 18)", "float": "float", "double": "double"}


def value(text: str, name: str) -> str:
    """SQL of the typed value of a text that is valid; null otherwise."""
    kind = TYPES[name]
    collapsed = normalized(text, kind.space)
    if kind.primitive in ("float", "double"):
        special = f"case {collapsed} when 'INF' then cast('Infinity' as {name}) when '+INF' then cast('Infinity' as {name}) when '-INF' then cast('-Infinity' as {name}) when 'NaN' then cast('NaN' as {name})"
        return f"{special} else try_cast({collapsed} as {name}) end"
    if name in _BITS or name in ("unsignedInt", "unsignedShort", "unsignedByte"):
        return f"try_cast({collapsed} as bigint)"
    if derives(name, "integer"):
        return f"try_cast({collapsed} as decimal(38, 0))"
    if kind.primitive in SQL_TYPES:
        return f"try_cast({collapsed} as {SQL_TYPES[kind.primitive]})"
    if kind.primitive == "date":
        return f"try_cast(regexp_extract({collapsed}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})', 1) as date)"
    if kind.primitive == "dateTime":
        return f"try_cast(regexp_extract({collapsed}, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T[0-9:.]+)', 1) as timestamp_ntz)"
    if kind.primitive == "hexBinary":
        return f"unhex({collapsed})"
    if kind.primitive == "base64Binary":
        return f"unbase64(replace({collapsed}, ' ', ''))"
    return collapsed
