"""String functions, regular expressions and URIs."""

from __future__ import annotations

from urllib.parse import urljoin

from treequill.functions.registry import function
from treequill.functions.values import EMPTY, Val, as_text, boolean, cast, error, fresh, integer, items_of, one, string, text_literal
from treequill.types import lexical, regex
from treequill.xpath.errors import XPathError

CODEPOINT = "http://www.w3.org/2005/xpath-functions/collation/codepoint"


def text(v: Val) -> str:
    """The string of an optional item; nothing is the empty string."""
    return f"coalesce({as_text(v)}, '')"


def fixed(v: Val, what: str) -> str:
    if not isinstance(v.const, str):
        raise XPathError("XPST0003", f"{what} must be a literal")
    return v.const


def collation(*args: Val) -> None:
    for v in args:
        if v.const is not None and v.const != CODEPOINT:
            raise XPathError("FOCH0002", f"unknown collation {v.const!r}")


def lets(value: str, body) -> str:
    """``body`` over a text that is computed once."""
    name = fresh("s")
    return f"element_at(transform(array({value}), {name} -> {body(name)}), 1)"


@function("concat", 2, None)
def concat(*args: Val) -> Val:
    return string(f"concat({', '.join(map(text, args))})")


@function("string-join", 2)
def string_join(items: Val, separator: Val) -> Val:
    name = fresh()
    parts = f"transform({items_of(items)}, {name} -> {as_text(Val(name, items.type, tz=None))})" if items.type not in ("string", "untyped", "empty") else items_of(items)
    return string(f"array_join({parts if items.type != 'empty' else 'cast(array() as array<string>)'}, {text(separator)})")


@function("substring", 2, 3)
def substring(source: Val, start: Val, length: Val | None = None) -> Val:
    """Characters whose place p has round(start) <= p < round(start) + round(length)."""
    source_text, first = text(source), f"floor({cast(start, 'double').sql} + 0.5D)"
    end = f"length({source_text}) + 1"
    if length is not None:
        end = f"least({end}, {first} + floor({cast(length, 'double').sql} + 0.5D))"
    low = f"greatest(1, {first})"
    nan = " or ".join(f"isnan({cast(v, 'double').sql})" for v in (start, length) if v is not None)
    return string(f"case when {nan} or {end} <= {low} then '' else substr({source_text}, cast({low} as int), cast({end} - {low} as int)) end")


@function("string-length", 1)
def string_length(v: Val) -> Val:
    return integer(f"cast(length({text(v)}) as bigint)")


@function("normalize-space", 1)
def normalize_space(v: Val) -> Val:
    return string(lexical.normalized(text(v), "collapse"))


@function("upper-case", 1)
def upper_case(v: Val) -> Val:
    return string(f"upper({text(v)})")


@function("lower-case", 1)
def lower_case(v: Val) -> Val:
    return string(f"lower({text(v)})")


@function("translate", 3)
def translate(source: Val, old: Val, new: Val) -> Val:
    return string(f"translate({text(source)}, {text(old)}, {text(new)})")


@function("contains", 2, 3)
def contains(source: Val, part: Val, *rest: Val) -> Val:
    collation(*rest)
    return boolean(f"contains({text(source)}, {text(part)})")


@function("starts-with", 2, 3)
def starts_with(source: Val, part: Val, *rest: Val) -> Val:
    collation(*rest)
    return boolean(f"startswith({text(source)}, {text(part)})")


@function("ends-with", 2, 3)
def ends_with(source: Val, part: Val, *rest: Val) -> Val:
    collation(*rest)
    return boolean(f"endswith({text(source)}, {text(part)})")


@function("substring-before", 2, 3)
def substring_before(source: Val, part: Val, *rest: Val) -> Val:
    collation(*rest)
    at = f"instr({text(source)}, {text(part)})"
    return string(f"case when {text(part)} = '' or {at} = 0 then '' else left({text(source)}, {at} - 1) end")


@function("substring-after", 2, 3)
def substring_after(source: Val, part: Val, *rest: Val) -> Val:
    collation(*rest)
    at = f"instr({text(source)}, {text(part)})"
    return string(f"case when {text(part)} = '' then {text(source)} when {at} = 0 then '' else substr({text(source)}, {at} + length({text(part)})) end")


@function("string-to-codepoints", 1)
def string_to_codepoints(v: Val) -> Val:
    name = fresh()
    return Val(f"transform(filter(split({text(v)}, ''), {name} -> {name} <> ''), {name} -> cast(ascii({name}) as bigint))", "integer", seq=True)


@function("codepoints-to-string", 1)
def codepoints_to_string(v: Val) -> Val:
    """Code points as UTF-8 bytes, decoded: ``chr`` knows Latin-1 only."""
    n = fresh()
    byte = lambda x: f"lpad(hex({x}), 2, '0')"
    utf8 = (
        f"case when {n} < 128 then {byte(n)} when {n} < 2048 then concat({byte(f'192 + {n} div 64')}, {byte(f'128 + {n} % 64')}) "
        f"when {n} < 65536 then concat({byte(f'224 + {n} div 4096')}, {byte(f'128 + {n} div 64 % 64')}, {byte(f'128 + {n} % 64')}) "
        f"else concat({byte(f'240 + {n} div 262144')}, {byte(f'128 + {n} div 4096 % 64')}, {byte(f'128 + {n} div 64 % 64')}, {byte(f'128 + {n} % 64')}) end"
    )
    known = f"{n} in (9, 10, 13) or {n} between 32 and 55295 or {n} between 57344 and 65533 or {n} between 65536 and 1114111"
    codes = items_of(cast_items(v, "integer"))
    return string(f"decode(unhex(array_join(transform({codes}, {n} -> case when {known} then {utf8} else {error('FOCH0001', 'no such character')} end), '')), 'UTF-8')")


def cast_items(v: Val, target: str) -> Val:
    if v.type in (target, "empty"):
        return v if v.type == target else Val(f"cast(array() as array<{'bigint' if target == 'integer' else 'string'}>)", target, seq=True)
    if not v.seq:
        return cast(v, target)
    name = fresh()
    return Val(f"transform({v.sql}, {name} -> {cast(Val(name, v.type), target).sql})", target, seq=True)


@function("compare", 2, 3)
def compare(a: Val, b: Val, *rest: Val) -> Val:
    collation(*rest)
    x, y = as_text(a), as_text(b)
    return integer(f"case when {x} < {y} then -1L when {x} = {y} then 0L when {x} > {y} then 1L end")


@function("codepoint-equal", 2)
def codepoint_equal(a: Val, b: Val) -> Val:
    return boolean(f"({as_text(a)} = {as_text(b)})")


@function("normalize-unicode", 1, 2)
def normalize_unicode(v: Val, form: Val | None = None) -> Val:
    name = "NFC" if form is None else fixed(form, "a normalization form").strip().upper()
    if name == "":
        return string(text(v))
    if name not in ("NFC", "NFD", "NFKC", "NFKD"):
        raise XPathError("FOCH0003", f"unknown normalization form {name!r}")
    return string(f"treequill_normalize({text(v)}, '{name}')")


def _percent(source: str, keep: str) -> str:
    """Every character outside the class ``keep`` as the %XX of its UTF-8 bytes."""
    c = fresh("c")
    escaped = f"regexp_replace(hex(encode({c}, 'UTF-8')), '(..)', '%$1')"
    return f"case when {source} rlike {regex.literal('^[' + keep + ']*$')} then {source} else array_join(transform(split({source}, ''), {c} -> if({c} rlike {regex.literal('^[' + keep + ']*$')}, {c}, {escaped})), '') end"


@function("encode-for-uri", 1)
def encode_for_uri(v: Val) -> Val:
    return string(lets(text(v), lambda s: _percent(s, r"A-Za-z0-9\-_.~")))


@function("iri-to-uri", 1)
def iri_to_uri(v: Val) -> Val:
    return string(lets(text(v), lambda s: _percent(s, r"\x21\x23-\x3B\x3D\x3F-\x5B\x5D\x5F\x61-\x7A\x7E")))


@function("escape-html-uri", 1)
def escape_html_uri(v: Val) -> Val:
    return string(lets(text(v), lambda s: _percent(s, r"\x20-\x7E")))


@function("resolve-uri", 1, 2, needs="context")
def resolve_uri(place, relative: Val, base: Val | None = None) -> Val:
    known = place.static.base_uri if base is None else base.const
    if isinstance(relative.const, str) and isinstance(known, str):
        return Val(text_literal(urljoin(known, relative.const)), "anyURI", const=urljoin(known, relative.const))
    if known is None and base is None:
        raise XPathError("FONS0005", "no base URI")
    return Val(f"treequill_resolve({as_text(relative)}, {text(base) if base is not None else text_literal(str(known))})", "anyURI")


@function("matches", 2, 3)
def matches(source: Val, pattern: Val, flags: Val | None = None) -> Val:
    java = regex.xpath_pattern(fixed(pattern, "a pattern"), fixed(flags, "flags") if flags else "")
    return boolean(f"({text(source)} rlike {regex.literal(java)})")


def _nonempty(pattern: Val, flags: Val | None) -> str:
    java = regex.xpath_pattern(fixed(pattern, "a pattern"), fixed(flags, "flags") if flags else "")
    if regex.may_be_empty(java):
        raise XPathError("FORX0003", "the pattern matches the empty string")
    return java


@function("replace", 3, 4)
def replace(source: Val, pattern: Val, by: Val, flags: Val | None = None) -> Val:
    java = _nonempty(pattern, flags)
    return string(f"regexp_replace({text(source)}, {regex.literal(java)}, {regex.literal(regex.replacement(fixed(by, 'a replacement')))})")


@function("tokenize", 2, 3)
def tokenize(source: Val, pattern: Val, flags: Val | None = None) -> Val:
    java = _nonempty(pattern, flags)
    return Val(lets(text(source), lambda s: f"if({s} = '', cast(array() as array<string>), split({s}, {regex.literal(java)}, -1))"), "string", seq=True)


@function("string", 1)
def to_string(v: Val) -> Val:
    if v.seq:
        v = one(v, "a string")
    return string(text(v))


@function("default-collation", 0)
def default_collation() -> Val:
    return Val(text_literal(CODEPOINT), "string", const=CODEPOINT)


@function("static-base-uri", 0, needs="context")
def static_base_uri(place) -> Val:
    base = place.static.base_uri
    return EMPTY if base is None else Val(text_literal(base), "anyURI", const=base)
