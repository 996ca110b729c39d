"""Validation in one pass over each document's events, for documents that needn't become node tables.

Documents are independent, so executors validate them where they are read: the
compiled schema travels in the closure, nothing is exchanged, and only violations
come out. A parser's memory is its open elements. Identity constraints and
assertions look across a document; for them use ``treequill.xsd.validate``, whose
codes and places these are.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Callable, Iterator
from decimal import Decimal, InvalidOperation

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treequill.operators import facets
from treequill.operators.facets import Simple
from treequill.plans.lineage import ship
from treequill.sources.shred import XML, XSI, NotWellFormed, decode
from treequill.types import lexical
from treequill.types.regex import schema_pattern
from treequill.xpath.errors import XPathError
from treequill.xsd.content import ELSEWHERE, alphabet, components, content_pattern
from treequill.xsd.schema import ANY_TYPE, PROCESS, Complex, Element, Schema, Type, derives, leaves, wildcards

OUTPUT = "doc {doc}, pre int, path string, line int, code string, message string"
#: Values and child sequences whose verdict is remembered for each type.
REMEMBERED = 50_000


def _compiled(java: str):
    """A Java pattern for the regex module."""
    import regex

    text = java.replace(r"\z", r"\Z")
    return regex.compile(regex.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\U{int(m[1], 16):08X}", text), regex.V1)


def _normal(text: str, space: str) -> str:
    if space == "preserve":
        return text
    text = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
    return text if space == "replace" else " ".join(p for p in text.split(" ") if p)


def _days(year: int, month: int, day: int) -> int:
    """Days of the proleptic Gregorian calendar."""
    year -= month <= 2
    era, of_era = divmod(year, 400)
    of_year = (153 * (month + (-3 if month > 2 else 9)) + 2) // 5 + day - 1
    return era * 146097 + of_era * 365 + of_era // 4 - of_era // 100 + of_year


def _leap(year: int) -> bool:
    return year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)


def _zone(text: str) -> tuple[str, int]:
    if text.endswith("Z"):
        return text[:-1], 0
    if len(text) > 6 and text[-6] in "+-" and text[-3] == ":":
        minutes = int(text[-5:-3]) * 60 + int(text[-2:])
        return text[:-6], -minutes if text[-6] == "-" else minutes
    return text, 0


def _date(text: str) -> tuple[int, int, int]:
    sign = -1 if text.startswith("-") else 1
    year, month, day = text.lstrip("-").split("-")
    return sign * int(year), int(month), int(day)


def _real(text: str) -> bool:
    year, month, day = _date(_zone(text.partition("T")[0])[0] if "T" not in text else text.partition("T")[0])
    return day <= (30 if month in (4, 6, 9, 11) else (29 if _leap(year) else 28) if month == 2 else 31)


def ordered(kind: Simple) -> Callable[[str], object]:
    """From a valid text to a value that compares as the type orders."""
    primitive = kind.primitive
    if primitive == "decimal":
        return Decimal
    if primitive in ("float", "double"):
        return lambda t: float(t.replace("INF", "inf"))

    def clock(t: str) -> Decimal:
        h, m, s = t.split(":")
        return int(h) * 3600 + int(m) * 60 + Decimal(s)

    def date(t: str) -> Decimal:
        plain, tz = _zone(t)
        return Decimal(_days(*_date(plain)) * 86400 - tz * 60)

    def date_time(t: str) -> Decimal:
        day, _, rest = t.partition("T")
        plain, tz = _zone(rest)
        return _days(*_date(day)) * 86400 + clock(plain) - tz * 60

    def time(t: str) -> Decimal:
        plain, tz = _zone(t)
        return clock(plain) - tz * 60

    def duration(t: str) -> Decimal:
        import re

        part = lambda p: Decimal(m[1]) if (m := re.search(p, t)) else Decimal(0)
        months = part(r"(\d+)Y") * 12 + part(r"^[^T]*?(\d+)M")
        secs = part(r"(\d+)D") * 86400 + part(r"T.*?(\d+)H") * 3600 + part(r"T.*?(\d+)M") * 60 + part(r"([\d.]+)S")
        return (months * 2629746 + secs) * (-1 if t.startswith("-") else 1)

    def number(t: str) -> int:
        import re

        m = re.search(r"-?\d+", t)
        return int(m[0]) if m else 0

    return {"dateTime": date_time, "date": date, "time": time, "duration": duration}.get(primitive, number)


def _size(kind: Simple) -> Callable[[str], int]:
    if kind.variety == "list":
        return lambda t: len(t.split(" ")) if t else 0
    if kind.primitive == "hexBinary":
        return lambda t: len(t) // 2
    if kind.primitive == "base64Binary":
        return lambda t: len(t.replace(" ", "").rstrip("=")) * 3 // 4
    return len


def checker(kind: Simple, version: str = "1.1") -> Callable[[str], str | None]:
    """A function from a text to the code of the first rule it breaks, which remembers what it has judged."""
    tests: list[tuple[str, Callable[[str], bool]]] = []
    if kind.variety == "atomic":
        tests.append(("cvc-datatype-valid", _lexical(kind.base, version)))
    elif kind.variety == "list":
        item = checker(kind.item, version)  # type: ignore[arg-type]
        tests.append(("cvc-datatype-valid", lambda t: not t or all(item(x) is None for x in t.split(" "))))
    else:
        members = [checker(m, version) for m in kind.members]
        tests.append(("cvc-datatype-valid", lambda t: any(m(t) is None for m in members)))
    for step in kind.steps:
        for name, values in step.items():
            test = _facet(kind, name, values)
            if test is not None:
                tests.append((f"cvc-{name}-valid", test))
    space, known = kind.space, {}  # type: ignore[var-annotated]

    def check(text: str) -> str | None:
        if text in known:
            return known[text]
        value = _normal(text, space)
        out = next((code for code, test in tests if not test(value)), None)
        if len(known) < REMEMBERED:
            known[text] = out
        return out

    return check


def _lexical(name: str, version: str) -> Callable[[str], bool]:
    kind = lexical.TYPES[name]
    if kind.pattern == r"(?s).*":
        return lambda t: True
    match = _compiled(kind.pattern).fullmatch

    def test(text: str) -> bool:
        t = _normal(text, kind.space)
        if not match(t):
            return False
        if kind.low is not None and int(t) < kind.low or kind.high is not None and int(t) > kind.high:
            return False
        if kind.primitive in ("date", "dateTime") and not _real(t):
            return False
        return not (version == "1.0" and (t == "+INF" and kind.primitive in ("float", "double") or t.lstrip("-").startswith("0000") and kind.primitive in ("dateTime", "date", "gYear", "gYearMonth")))

    return test


def _facet(kind: Simple, name: str, values: list[str]) -> Callable[[str], bool] | None:
    last = values[-1]
    if name == "assertion":
        raise XPathError("cvc-assertion", f"{kind.name} has an assertion, which only treequill.xsd.validate evaluates")
    if name == "pattern":
        match = _compiled(schema_pattern(values)).search
        return lambda t: match(t) is not None
    if name == "enumeration":
        if kind.variety == "atomic" and kind.primitive in facets._BY_VALUE:
            value = ordered(kind)
            allowed = {value(v.strip()) for v in values}
            return lambda t: value(t) in allowed
        texts = {v if kind.space == "preserve" else " ".join(v.split()) for v in values}
        return lambda t: t in texts
    if name in facets.LENGTHS:
        if kind.variety == "atomic" and kind.primitive in ("QName", "NOTATION"):
            return None
        size, n = _size(kind), int(last)
        return {"length": lambda t: size(t) == n, "minLength": lambda t: size(t) >= n, "maxLength": lambda t: size(t) <= n}[name]
    if name in facets.BOUNDS:
        value = ordered(kind)
        bound = value(last.strip())
        return {"minInclusive": lambda t: value(t) >= bound, "minExclusive": lambda t: value(t) > bound, "maxInclusive": lambda t: value(t) <= bound, "maxExclusive": lambda t: value(t) < bound}[name]  # type: ignore[operator]
    if name in ("totalDigits", "fractionDigits"):
        n = int(last)

        def digits(t: str) -> bool:
            whole, _, fraction = t.lstrip("+-").lstrip("0").partition(".")
            fraction = fraction.rstrip("0")
            return len(fraction) <= n if name == "fractionDigits" else len(whole) + len(fraction if whole else fraction.lstrip("0")) <= n

        return digits
    if name == "explicitTimezone" and last != "optional":
        want = last == "required"
        return lambda t: (t.endswith("Z") or len(t) > 6 and t[-6] in "+-" and t[-3] == ":") == want
    return None


class Plan:
    """The schema as dictionaries, for one Python worker."""

    def __init__(self, schema: Schema, strict: bool = True, xml_attributes: bool = True) -> None:
        self.schema, self.strict, self.xml_attributes = schema, strict, xml_attributes
        self.names = alphabet(schema)
        self.checkers: dict[int, Callable[[str], str | None]] = {}
        self.models: dict[int, Model] = {}

    def check(self, kind: Simple) -> Callable[[str], str | None]:
        found = self.checkers.get(id(kind))
        if found is None:
            found = self.checkers[id(kind)] = checker(kind, self.schema.version)
        return found

    def model(self, kind: Complex) -> Model:
        found = self.models.get(id(kind))
        if found is None:
            found = self.models[id(kind)] = Model(kind, self)
        return found

    def symbol(self, name: tuple[str, str]) -> str:
        found = self.names.known.get(name)
        return found or self.names.unknown.get(name[0]) or self.names.unknown[ELSEWHERE]

    def alternative(self, e: Element, attributes: dict[tuple[str, str], str]) -> Type | None:
        for test, kind, _ in e.alternatives:
            if test is None or _holds(test, attributes):
                return kind
        return None


def _holds(test: str, attributes: dict[tuple[str, str], str]) -> bool:
    """A type alternative's test: comparisons and tests of attributes joined by and, or and not()."""
    from treequill.xpath import ast as A
    from treequill.xpath.parser import parse

    def value(e: A.Expr):
        if isinstance(e, A.Literal):
            return e.value
        if isinstance(e, A.Path) and len(e.steps) == 1 and isinstance(e.steps[0], A.Step) and e.steps[0].axis == "attribute":
            return attributes.get(("", e.steps[0].test.local))
        if isinstance(e, A.Binary) and e.op in ("and", "or"):
            return (bool(value(e.left)) and bool(value(e.right))) if e.op == "and" else (bool(value(e.left)) or bool(value(e.right)))
        if isinstance(e, A.Call) and e.name in ("not", "fn:not"):
            return not value(e.args[0])
        if isinstance(e, A.Binary):
            a, b = value(e.left), value(e.right)
            if a is None or b is None:
                return False
            if not isinstance(a, str) or not isinstance(b, str):
                try:
                    a, b = float(a), float(b)
                except ValueError:
                    return False
            return {"=": a == b, "eq": a == b, "!=": a != b, "ne": a != b, "<": a < b, "lt": a < b, "<=": a <= b, "le": a <= b, ">": a > b, "gt": a > b, ">=": a >= b, "ge": a >= b}[e.op]
        raise ValueError(f"{test!r} is more than this pass evaluates")

    found = value(parse(test))
    return found is not None if not isinstance(found, bool) else found


class Model:
    """A complex type's content: the pattern of its children, remembered by word, and what its names declare."""

    def __init__(self, kind: Complex, plan: Plan) -> None:
        import re

        self.content = kind.content
        self.match = re.compile(content_pattern(kind, plan.schema, plan.names)).search
        self.known: dict[str, bool] = {}
        self.children: dict[tuple[str, str], Element] = {}
        self.wildcards = sorted(wildcards(kind), key=lambda w: PROCESS.index(w.process))
        for p in leaves(kind.particle):
            if p.element is not None:
                self.children[p.element.name] = p.element
                if p.element.is_global:
                    self.children |= {e.name: e for e in plan.schema.substitutes(p.element)}
        self.attributes = kind.attributes
        self.required = [n for n, a in kind.attributes.items() if a.required]
        self.any_attribute = kind.any_attribute
        self.simple = plan.check(kind.simple) if kind.simple is not None else None

    def accepts(self, word: str) -> bool:
        found = self.known.get(word)
        if found is None:
            found = self.match(word) is not None
            if len(self.known) < REMEMBERED and len(word) <= 1000:
                self.known[word] = found
        return found


_REFS = ("ID", "IDREF", "IDREFS")


class _Frame:
    __slots__ = ("local", "pre", "line", "type", "decl", "word", "text", "nil", "parts", "process", "model")


class Document:
    """One document's pass."""

    def __init__(self, plan: Plan, doc: object) -> None:
        self.plan, self.doc, self.out = plan, doc, []
        self.count, self.stack, self.data = 1, [], []
        self.collectors: list[list[str]] = []
        self.prefixes: dict[str, list[str]] = {}
        self.declared = 0
        self.ids: dict[str, list[int]] = {}
        self.refs: list[tuple[int, str]] = []

    def run(self, text: str | None) -> list[tuple]:
        parser = self.parser = expat.ParserCreate("utf-8", namespace_separator=" ")
        parser.ordered_attributes = parser.buffer_text = True
        parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = self.start, self.end, self.data_
        parser.CommentHandler, parser.ProcessingInstructionHandler = self.other, self.other
        parser.StartNamespaceDeclHandler, parser.EndNamespaceDeclHandler = self.open_prefix, self.close_prefix
        parser.EntityDeclHandler = self.entity
        try:
            parser.Parse((text or "").encode(), True)
        except (expat.ExpatError, NotWellFormed) as e:
            return [(self.doc, 0, "", parser.CurrentLineNumber, "sch-not-well-formed", str(e))]
        for name, places in self.ids.items():
            if len(places) > 1:
                self.out.append((self.doc, min(places), "", None, "cvc-id.2", f"ID {name}"))
        for pre, name in self.refs:
            if name not in self.ids:
                self.out.append((self.doc, pre, "", None, "cvc-id.1", f"IDREF {name}"))
        return self.out

    def entity(self, name: str, *rest: object) -> None:
        raise NotWellFormed(f"entity {name} is declared")

    def open_prefix(self, prefix: str | None, uri: str | None) -> None:
        self.prefixes.setdefault(prefix or "", []).append(uri or "")
        self.declared += 1

    def close_prefix(self, prefix: str | None) -> None:
        self.prefixes[prefix or ""].pop()

    def data_(self, data: str) -> None:
        self.data.append(data)

    def other(self, *rest: object) -> None:
        self.flush()
        self.count += 1

    def flush(self) -> None:
        if self.data:
            if self.stack:
                data = "".join(self.data)
                self.count += 1
                frame = self.stack[-1]
                if frame.text < 2:
                    frame.text = 2 if data.strip(" \t\r\n") else 1
                for parts in self.collectors:
                    parts.append(data)
            self.data = []

    def bad(self, frame: _Frame, code: str, what: str) -> None:
        path = "".join(f"/{f.local}" for f in self.stack)
        self.out.append((self.doc, frame.pre, path if self.stack and self.stack[-1] is frame else f"{path}/{frame.local}", frame.line, code, f"{what} {frame.local}"))

    def start(self, name: str, attributes: list[str]) -> None:
        if self.data:
            self.flush()
        plan, schema = self.plan, self.plan.schema
        ns, _, local = name.rpartition(" ")
        qname = (ns, local)
        frame = _Frame()
        frame.local, frame.pre, frame.line, frame.word, frame.text, frame.nil, frame.parts = local, self.count, self.parser.CurrentLineNumber, [], 0, False, None
        self.count += 1 + self.declared
        self.declared = 0
        first_attribute = self.count
        self.count += len(attributes) // 2
        decl, process = None, "strict" if plan.strict else "lax"
        if self.stack:
            above = self.stack[-1]
            above.word.append(plan.symbol(qname))
            process = "none"
            if above.model is not None:
                decl = above.model.children.get(qname)
                if decl is not None:
                    process = "strict"
                elif (wild := next((w for w in above.model.wildcards if w.admits(ns, local)), None)) is not None:
                    process = wild.process
                    decl = schema.elements.get(qname) if process != "skip" else None
        else:
            decl = schema.elements.get(qname)
        self.stack.append(frame)
        kind = decl.type if decl is not None else None
        own: dict[tuple[str, str], tuple[int, str]] = {}
        xsi: dict[str, str] = {}
        for i in range(0, len(attributes), 2):
            space, _, key = attributes[i].rpartition(" ")
            if space == XSI:
                xsi[key] = attributes[i + 1]
            else:
                own[space, key] = (first_attribute + i // 2, attributes[i + 1])
        if decl is not None and decl.alternatives:
            kind = plan.alternative(decl, {k: v for k, (_, v) in own.items()}) or kind
        if "type" in xsi and (decl is not None or process != "none"):
            prefix, _, short = xsi["type"].strip().rpartition(":")
            uris = self.prefixes.get(prefix)
            found = schema.types.get((uris[-1] if uris else "", short))
            if found is not None and (kind is None or derives(found, kind)):
                kind = found
            else:
                self.bad(frame, "cvc-elt.4.3" if found is not None else "cvc-elt.4.2", "element")
        if kind is None and process == "lax":
            kind = ANY_TYPE
        frame.decl, frame.process, frame.type = decl, process, kind
        frame.model = plan.model(kind) if isinstance(kind, Complex) else None
        if decl is None and process == "strict" and kind is None:
            self.bad(frame, "cvc-elt.1", "element")
        if decl is not None and decl.abstract:
            self.bad(frame, "cvc-elt.2", "element")
        if "nil" in xsi and decl is not None:
            if not decl.nillable:
                self.bad(frame, "cvc-elt.3.1", "element")
            frame.nil = xsi["nil"].strip() in ("true", "1")
        if isinstance(kind, Complex) and kind.abstract:
            self.bad(frame, "cvc-type.2", "element")
        if isinstance(kind, Simple) or frame.model is not None and frame.model.simple is not None:
            frame.parts = []
            self.collectors.append(frame.parts)
        if frame.model is not None:
            self.attributes(frame, frame.model, own)
        elif isinstance(kind, Simple):
            for key, (pre, _) in own.items():
                if not (plan.xml_attributes and key[0] == XML):
                    self.attribute_bad(frame, pre, key[1], "cvc-complex-type.3.2.2")

    def attribute_bad(self, frame: _Frame, pre: int, local: str, code: str) -> None:
        path = "".join(f"/{f.local}" for f in self.stack)
        self.out.append((self.doc, pre, f"{path}/@{local}", frame.line, code, f"attribute {local}"))

    def attributes(self, frame: _Frame, model: Model, own: dict[tuple[str, str], tuple[int, str]]) -> None:
        plan = self.plan
        for name, (pre, value) in own.items():
            use = model.attributes.get(name)
            code = None
            if use is not None:
                code = plan.check(use.type)(value)
                if code is None and use.fixed is not None and not _same(use.type, value, use.fixed):
                    code = "cvc-attribute.4"
                self.reference(use.type, pre, value)
            else:
                known = plan.schema.attributes.get(name)
                lenient = plan.xml_attributes and name[0] == XML
                wild = model.any_attribute
                if not (wild is not None and wild.admits(*name)) and not lenient:
                    code = "cvc-complex-type.3.2.2"
                elif wild is not None and wild.process == "strict" and known is None and not lenient:
                    code = "cvc-assess-attr.1.2"
                elif wild is not None and wild.process != "skip" and known is not None:
                    code = plan.check(known.type)(value)
            if code is not None:
                self.attribute_bad(frame, pre, name[1], code)
        for name in model.required:
            if name not in own:
                path = "".join(f"/{f.local}" for f in self.stack)
                self.out.append((self.doc, frame.pre, path, frame.line, "cvc-complex-type.4", f"attribute {name[1]}"))

    def reference(self, kind: Simple, pre: int, value: str) -> None:
        found = next((n for n in _REFS if n in kind.ancestors), None)
        if found == "ID":
            self.ids.setdefault(value.strip(" "), []).append(pre)
        elif found is not None:
            self.refs += [(pre, v) for v in (value.split() if value.strip() else [""])]

    def end(self, name: str) -> None:
        if self.data:
            self.flush()
        frame = self.stack[-1]
        kind, model, decl = frame.type, frame.model, frame.decl
        if frame.parts is not None:
            self.collectors.pop()
        if frame.nil and decl is not None and decl.nillable:
            if frame.word or frame.text:
                self.bad(frame, "cvc-elt.3.2.1", "content of")
        elif model is not None:
            word = "".join(frame.word)
            if model.content == "simple":
                if word:
                    self.bad(frame, "cvc-complex-type.2.2", "content of")
            elif model.content == "empty":
                if word or frame.text:
                    self.bad(frame, "cvc-complex-type.2.1", "content of")
            elif not model.accepts(word):
                self.bad(frame, "cvc-complex-type.2.4", "content of")
            elif model.content == "element" and frame.text > 1:
                self.bad(frame, "cvc-complex-type.2.3", "content of")
        elif kind is not None and frame.word:
            self.bad(frame, "cvc-type.3.1.2", "content of")
        if frame.parts is not None and not frame.nil:
            simple = kind if isinstance(kind, Simple) else kind.simple  # type: ignore[union-attr]
            text = "".join(frame.parts)
            if not text and decl is not None:
                text = decl.fixed if decl.fixed is not None else decl.default or ""
            code = self.plan.check(simple)(text)
            if code is None and decl is not None and decl.fixed is not None and not _same(simple, text, decl.fixed):
                code = "cvc-elt.5.2.2.2"
            if code is not None:
                self.bad(frame, code, "value of")
            self.reference(simple, frame.pre, text)
        self.stack.pop()


def _same(kind: Simple, text: str, fixed: str) -> bool:
    a, b = text.strip(" \t\n\r"), fixed.strip(" \t\n\r")
    if a == b:
        return True
    if kind.variety == "atomic" and kind.primitive == "decimal":
        try:
            return Decimal(a) == Decimal(b)
        except InvalidOperation:
            return False
    return False


def _rows(schema: Schema, strict: bool, xml_attributes: bool, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Plan(schema, strict, xml_attributes)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += Document(plan, doc).run(decode(text) if isinstance(text, bytes) else text)
                except (NotWellFormed, UnicodeDecodeError) as e:
                    out.append((doc, 0, "", None, "sch-not-well-formed", str(e)))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return run


def violations(docs: DataFrame, schema: Schema, strict: bool = True, xml_attributes: bool = True, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """(doc, pre, path, line, code, message) of a table of documents. Streams may be validated so as well: the plan is one stateless step."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship(docs.sparkSession)
    for kind in components(schema)[1]:  # a type that can't be checked here is an error before any document is read
        simple = kind if isinstance(kind, Simple) else kind.simple
        if simple is not None:
            checker(simple, schema.version)
    out = _parse_datatype_string(OUTPUT.format(doc=docs.schema[doc].dataType.simpleString()))
    return docs.select(doc, xml).mapInArrow(_rows(schema, strict, xml_attributes, to_arrow_schema(out)), out)


def of_files(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """The violations of XML files, named by their paths."""
    files = spark.read.format("binaryFile").load(path).selectExpr("path as doc_id", "content as xml")
    return violations(files, schema)
