"""Simple types as SQL: facets, lists, unions, and the code of the first rule that a text breaks."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treequill.types import lexical
from treequill.types.regex import literal, schema_pattern
from treequill.xpath.errors import XPathError

BOUNDS = {"minInclusive": ">=", "minExclusive": ">", "maxInclusive": "<=", "maxExclusive": "<"}
LENGTHS = {"length": "=", "minLength": ">=", "maxLength": "<="}
FACETS = {*BOUNDS, *LENGTHS, "pattern", "enumeration", "whiteSpace", "totalDigits", "fractionDigits", "explicitTimezone", "assertion"}
_ORDERED = {"decimal", "float", "double", "duration", "dateTime", "date", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"}
_TEMPORAL = {"dateTime", "date", "time", "gYear", "gYearMonth", "gMonth", "gMonthDay", "gDay"}
#: Primitives whose enumerations compare values; the others compare collapsed texts.
_BY_VALUE = {"float", "double", "duration", "dateTime", "date", "time"}


@dataclass
class Simple:
    """A simple type: its built-in root, or items or members, and the facets of each derivation step, base first."""

    name: str
    base: str = "string"
    variety: str = "atomic"
    steps: list[dict[str, list[str]]] = field(default_factory=list)
    item: Simple | None = None
    members: tuple[Simple, ...] = ()
    #: Names of all types that this one is derived from, itself first.
    ancestors: tuple[str, ...] = ()

    def restricted(self, name: str, facets: dict[str, list[str]]) -> Simple:
        """A restriction of this type; XPathError with a schema code if a facet doesn't apply or contradicts."""
        check_facets(self, facets)
        return Simple(name, self.base, self.variety, [*self.steps, facets], self.item, self.members, (name, *self.ancestors))

    @property
    def primitive(self) -> str:
        return lexical.TYPES[self.base].primitive if self.variety == "atomic" else self.variety

    def facet(self, name: str) -> str | None:
        """The value of a single-valued facet in force: the last step's that has one."""
        found = [s[name][-1] for s in self.steps if name in s]
        return found[-1] if found else None

    @property
    def space(self) -> str:
        if self.variety == "list":
            return "collapse"
        own = self.facet("whiteSpace")
        return own or (lexical.TYPES[self.base].space if self.variety == "atomic" else "preserve")


def builtin(name: str) -> Simple:
    kind = lexical.TYPES[name]
    chain, at = [], name
    while at in lexical.TYPES:
        chain.append(at)
        at = lexical.TYPES[at].base
    if kind.item:
        return Simple(name, "string", "list", [{"minLength": ["1"]}], builtin(kind.item), ancestors=tuple(chain))
    return Simple(name, name, ancestors=tuple(chain))


def list_of(name: str, item: Simple) -> Simple:
    if item.variety == "list" or any(m.variety == "list" for m in item.members):
        raise XPathError("cos-list-of-atomic", f"{name} is a list of lists")
    return Simple(name, "string", "list", [], item, ancestors=(name, "anySimpleType"))


def union_of(name: str, members: tuple[Simple, ...]) -> Simple:
    return Simple(name, "string", "union", [], None, members, (name, "anySimpleType"))


def applicable(kind: Simple) -> set[str]:
    """Names of the facets that may restrict a type."""
    if kind.variety == "union":
        return {"pattern", "enumeration", "assertion"}
    if kind.variety == "list":
        return {*LENGTHS, "pattern", "enumeration", "whiteSpace", "assertion"}
    primitive = kind.primitive
    out = {"pattern", "whiteSpace", "assertion", "enumeration"} - ({"enumeration"} if primitive == "boolean" else set())
    if primitive in ("string", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION"):
        out |= set(LENGTHS)
    if primitive in _ORDERED:
        out |= set(BOUNDS)
    if primitive == "decimal":
        out |= {"totalDigits", "fractionDigits"}
    if primitive in _TEMPORAL:
        out.add("explicitTimezone")
    return out


def _number(text: str) -> Decimal | None:
    try:
        return Decimal(text.strip())
    except InvalidOperation:
        return None


def check_facets(base: Simple, facets: dict[str, list[str]]) -> None:
    """Raises if a facet doesn't apply to the base, isn't a value of it, or contradicts another one in force."""
    for name, values in facets.items():
        if name not in applicable(base):
            raise XPathError("cos-applicable-facets", f"{name} does not restrict {base.name}")
        if name == "pattern":
            schema_pattern(values)
        if name in LENGTHS or name in ("totalDigits", "fractionDigits"):
            if not values[-1].strip().isdigit() or name == "totalDigits" and int(values[-1]) < 1:
                raise XPathError("st-props-correct", f"{name} is {values[-1]!r}")
    order = {"preserve": 0, "replace": 1, "collapse": 2}
    if "whiteSpace" in facets and order[facets["whiteSpace"][-1]] < order[base.space]:
        raise XPathError("st-props-correct", "white space may only get stricter")
    merged = Simple("", base.base, base.variety, [*base.steps, facets])
    number = lambda f: _number(merged.facet(f) or "")
    pairs = [("minLength", "maxLength", False), ("minInclusive", "maxInclusive", False), ("minExclusive", "maxExclusive", False), ("minInclusive", "maxExclusive", True), ("minExclusive", "maxInclusive", True), ("fractionDigits", "totalDigits", False)]
    for low, high, strict in pairs:
        a, b = number(low), number(high)
        if a is not None and b is not None and (a >= b if strict else a > b):
            raise XPathError("st-props-correct", f"{low} {a} and {high} {b}")
    if ("minInclusive" in facets and "minExclusive" in facets) or ("maxInclusive" in facets and "maxExclusive" in facets):
        raise XPathError("st-props-correct", "two bounds of one kind")
    for name in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive", "minLength", "maxLength", "totalDigits", "fractionDigits"):
        if name not in facets or base.facet(name) is None:
            continue
        a, b = _number(facets[name][-1]), _number(base.facet(name) or "")
        if a is not None and b is not None and (a < b if name.startswith("min") else a > b):
            raise XPathError(f"{name}-valid-restriction", f"{a} loosens {b}")


def _size(value: str, kind: Simple) -> str:
    if kind.variety == "list":
        return f"if({value} = '', 0, size(split({value}, ' ')))"
    if kind.primitive == "hexBinary":
        return f"length({value}) div 2"
    if kind.primitive == "base64Binary":
        return f"octet_length(unbase64(replace({value}, ' ', '')))"
    return f"length({value})"


def _comparable(text: str, kind: Simple) -> str:
    """SQL of a value that ``<`` orders as the type does."""
    from treequill.functions.values import Val, cast

    primitive = kind.primitive
    if primitive in ("dateTime", "date", "time"):
        v = cast(Val(text, "string"), primitive, True)
        if primitive == "time":
            return f"({v.sql} - coalesce({v.tz}, 0) * 60)"
        return f"timestampadd(MINUTE, -coalesce({v.tz}, 0), cast({v.sql} as timestamp_ntz))"
    if primitive == "duration":
        v = cast(Val(text, "string"), "duration", True)
        return f"({v.sql} * 2629746 + {v.secs})"
    if primitive == "decimal":
        return f"try_cast({text} as decimal(38, 18))"
    if primitive in ("float", "double"):
        return f"({lexical.value(text, primitive)})"
    return f"try_cast(regexp_extract({text}, '(-?[0-9]+)', 1) as bigint)"


#: XPath types of the primitives that assertions see typed; other values are strings there.
_XPATH_TYPES = {"decimal", "float", "double", "boolean", "dateTime", "date", "time", "duration"}


def _asserted(value: str, kind: Simple, test: str) -> str:
    """SQL of an assertion, with ``$value`` bound to the typed value: a sequence for lists, untyped for unions."""
    from treequill.functions.values import Val, cast, ebv
    from treequill.plans.compiler import Compiler, Place, Static
    from treequill.xpath.parser import parse

    def typed(text: str, of: Simple) -> Val:
        if of.variety == "union":
            return Val(text, "untyped")
        target = "integer" if of.primitive == "decimal" and lexical.derives(of.base, "integer") else of.primitive
        return cast(Val(text, "string"), target, True) if target in {*_XPATH_TYPES, "integer"} else Val(text, "string")

    if kind.variety == "list":
        assert kind.item is not None
        item = typed("i", kind.item)
        bound = Val(f"if({value} = '', array(), transform(split({value}, ' '), i -> {item.sql}))", item.type, seq=True)
    else:
        bound = typed(value, kind)
    static = Static()
    static.variables["value"] = bound
    return ebv(Compiler(static).value(parse(test), Place(static, vars={"value": bound})))


def _step(value: str, kind: Simple, facets: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(code, SQL test that must hold) of the facets of one step."""
    out = []
    for name, values in facets.items():
        last = values[-1]
        code = f"cvc-{name}-valid"
        if name == "assertion":
            out += [("cvc-assertion", _asserted(value, kind, test)) for test in values]
            continue
        if name == "pattern":
            out.append((code, f"{value} rlike {literal(schema_pattern(values))}"))
        elif name == "enumeration":
            if kind.variety == "atomic" and kind.primitive in _BY_VALUE:
                texts = ", ".join(_comparable(literal(v.strip()), kind) for v in values)
                out.append((code, f"{_comparable(value, kind)} in ({texts})"))
            else:
                out.append((code, f"{value} in ({', '.join(literal(v if kind.space == 'preserve' else ' '.join(v.split())) for v in values)})"))
        elif name in LENGTHS:
            if kind.variety == "list" or kind.primitive not in ("QName", "NOTATION"):
                out.append((code, f"{_size(value, kind)} {LENGTHS[name]} {int(last)}"))
        elif name in BOUNDS:
            out.append((code, f"{_comparable(value, kind)} {BOUNDS[name]} {_comparable(literal(last.strip()), kind)}"))
        elif name == "totalDigits":
            digits = f"regexp_replace(regexp_replace(regexp_replace({value}, '^[+-]?0*', ''), '([.][0-9]*?)0*$', '$1'), '^[.]0*|[.]', '')"
            out.append((code, f"length({digits}) <= {int(last)}"))
        elif name == "fractionDigits":
            out.append((code, f"length(regexp_extract({value}, '[.]([0-9]*?)0*$', 1)) <= {int(last)}"))
        elif name == "explicitTimezone" and last != "optional":
            zoned = f"{value} rlike '(Z|[+-][0-9]{{2}}:[0-9]{{2}})$'"
            out.append((code, zoned if last == "required" else f"not {zoned}"))
    return out


def code_of(text: str, kind: Simple, version: str = "1.1") -> str:
    """SQL of the code of the first rule that a text breaks; null for a valid text."""
    value = lexical.normalized(text, kind.space)
    tests: list[tuple[str, str]] = []
    if kind.variety == "atomic":
        tests.append(("cvc-datatype-valid", lexical.valid(value, kind.base, version)))
    elif kind.variety == "list":
        assert kind.item is not None
        tests.append(("cvc-datatype-valid", f"({value} = '' or forall(split({value}, ' '), i -> {code_of('i', kind.item, version)} is null))"))
    else:
        fits = " or ".join(f"({code_of(text, m, version)}) is null" for m in kind.members) or "false"
        tests.append(("cvc-datatype-valid", f"({fits})"))
    for step in kind.steps:
        tests += _step(value, kind, step)
    branches = " ".join(f"when not coalesce({test}, false) then '{code}'" for code, test in tests)
    return f"case when {text} is null then null {branches} end"


def member_of(text: str, kind: Simple, version: str = "1.1") -> str:
    """SQL of the name of the union's first member that a text is valid for."""
    return "case " + " ".join(f"when ({code_of(text, m, version)}) is null then '{m.name}'" for m in kind.members) + " end"


def _typed_bounds(column: str, kind: Simple, values: T.DataType) -> list[tuple[str, str]] | None:
    """(code, SQL that is true where the value breaks it) for a numeric column and a type with bounds only; None if the text has to be judged."""
    if kind.variety != "atomic" or any(name not in BOUNDS for step in kind.steps for name in step):
        return None
    whole = isinstance(values, T.ByteType | T.ShortType | T.IntegerType | T.LongType)
    if not ((whole or isinstance(values, T.DecimalType)) and kind.base == "decimal" or whole and kind.base in ("integer", "long") or isinstance(values, T.DoubleType) and kind.base == "double"):
        return None
    negated = {">=": "<", ">": "<=", "<=": ">", "<": ">="}
    out = []
    for step in kind.steps:
        for name, texts in step.items():
            bound = _number(texts[-1])
            if bound is None or not bound.is_finite():
                return None
            text = f"{float(bound)!r}D" if kind.base == "double" else f"{bound:f}" + ("BD" if "." in f"{bound:f}" else "L" if abs(bound) < 2**63 else "BD")
            # Spark puts NaN above all numbers; it is in no bounds.
            odd = f" or isnan({column})" if kind.base == "double" and name.startswith("min") else ""
            out.append((f"cvc-{name}-valid", f"{column} {negated[BOUNDS[name]]} {text}{odd}"))
    return out


def check_column(df: DataFrame, column: str, kind: Simple, keys: list[str], version: str = "1.1") -> DataFrame:
    """(keys, value, code) of the rows whose value breaks the type; null values are absent and pass.

    Bounds of numeric columns compare the column itself, so they reach the scan; all else is judged by its text.
    """
    typed = _typed_bounds(f"`{column}`", kind, df.schema[column].dataType)
    if typed:
        broken = F.expr(" or ".join(f"({test})" for _, test in typed))
        code = F.expr("case " + " ".join(f"when {test} then '{code}'" for code, test in typed) + " end")
        return df.where(F.col(f"`{column}`").isNotNull() & broken).select(*keys, F.col(f"`{column}`").cast("string").alias("value"), code.alias("code"))
    text = F.col(column).cast("string").alias("value")
    found = df.select(*keys, text).withColumn("code", F.expr(code_of("value", kind, version)))
    return found.where("code is not null")
