"""XML Schema and XPath regular expressions in Java's dialect.

Differences that are translated: ``\\i`` and ``\\c``, block escapes ``\\p{IsX}``,
class subtraction ``[a-z-[aeiou]]``, a dot that stops at carriage returns too, and
the anchors, which schema patterns imply and do not know as characters.
"""

from __future__ import annotations

import re

from treequill.xpath.errors import XPathError

_NAME_START = r":_\p{L}\x{2160}-\x{2188}"
_NAME_CHAR = r"\-.:_\p{L}\p{N}\p{M}\x{B7}"
_SINGLE = set("nrt\\|.?*+(){}-[]^$")


def literal(text: str) -> str:
    """``text`` as a SQL string literal without escape processing."""
    if "'" not in text:
        return f"r'{text}'"
    if '"' not in text:
        return f'r"{text}"'
    return "concat(" + ", \"'\", ".join(f"r'{part}'" for part in text.split("'")) + ")"


class _Translator:
    def __init__(self, pattern: str, schema: bool, code: str) -> None:
        self.text, self.at, self.schema, self.code = pattern, 0, schema, code

    def fail(self, why: str) -> XPathError:
        return XPathError(self.code, f"bad pattern {self.text!r}: {why}")

    def more(self) -> bool:
        return self.at < len(self.text)

    def next(self) -> str:
        if not self.more():
            raise self.fail("it ends early")
        self.at += 1
        return self.text[self.at - 1]

    def escape(self, inside: bool) -> str:
        c = self.next()
        if c in _SINGLE:
            return "\\" + c
        if c in "sSdDwW":
            body = {"s": r"\x20\t\n\r", "d": r"\p{Nd}", "w": r"\p{L}\p{M}\p{N}\p{S}"}[c.lower()]
            if c.islower():
                return body if inside else f"[{body}]"
            return f"[^{body}]"
        if c in "iIcC":
            body = _NAME_START if c in "iI" else _NAME_CHAR
            if c.islower():
                return body if inside else f"[{body}]"
            return f"[^{body}]"
        if c in "pP":
            m = re.compile(r"\{(Is)?([A-Za-z0-9\-]+)\}").match(self.text, self.at)
            if not m:
                raise self.fail("a category needs braces")
            self.at = m.end()
            return f"\\{c}{{{'In' + m[2].replace('-', '_') if m[1] else m[2]}}}"
        if not self.schema and not inside and c.isdigit():
            return "\\" + c
        raise self.fail(f"no escape is called \\{c}")

    def char_class(self) -> str:
        out = "["
        if self.more() and self.text[self.at] == "^":
            out += self.next()
        first = True
        while True:
            c = self.next()
            if c == "]" and not first:
                return out + "]"
            if c == "]":
                raise self.fail("an empty class")
            if c == "[":
                raise self.fail("a class in a class")
            if c == "-" and self.more() and self.text[self.at] == "[":
                self.at += 1
                inner = self.char_class()
                if not self.more() or self.next() != "]":
                    raise self.fail("a subtraction ends its class")
                return f"{out}&&[^{inner[1:]}]" if not inner.startswith("[^") else f"{out}&&[{inner[2:]}]"
            out += self.escape(True) if c == "\\" else "\\" + c if c in "&~" else c
            first = False

    def run(self) -> str:
        out, depth = [], 0
        while self.more():
            c = self.next()
            if c == "\\":
                out.append(self.escape(False))
            elif c == "[":
                out.append(self.char_class())
            elif c == ".":
                out.append(r"[^\n\r]")
            elif c in "^$" and self.schema:
                out.append("\\" + c)
            elif c in "]}":
                raise self.fail(f"a stray {c}")
            elif c == "{":
                m = re.compile(r"(\d+)(,(\d*))?\}").match(self.text, self.at)
                if not m or m[3] and int(m[3]) < int(m[1]):
                    raise self.fail("a bad quantity")
                out.append("{" + m.group())
                self.at = m.end()
            else:
                depth += (c == "(") - (c == ")")
                if depth < 0:
                    raise self.fail("a stray )")
                if c == "(" and self.text[self.at : self.at + 1] == "?":
                    raise self.fail("a group starts with ?")
                out.append(c)
        if depth:
            raise self.fail("a group is open")
        return "".join(out)


def schema_pattern(patterns: list[str]) -> str:
    """The anchored Java pattern of the patterns of one derivation step, any of which may match."""
    parts = [_Translator(p, True, "cvc-pattern-valid").run() for p in patterns]
    return "^(?:" + "|".join(f"(?:{p})" for p in parts) + r")\z"


def xpath_pattern(pattern: str, flags: str = "") -> str:
    """The Java pattern of a pattern of fn:matches, with its flags."""
    if set(flags) - set("smix"):
        raise XPathError("FORX0001", f"unknown flags {flags!r}")
    if "x" in flags:
        pattern = re.sub(r"[ \t\n\r]+(?![^\[]*\])", "", pattern)
    body = _Translator(pattern, False, "FORX0002").run()
    if "s" in flags:
        body = body.replace(r"[^\n\r]", r"(?s:.)")
    on = ("(?i)(?u)" if "i" in flags else "") + ("(?m)" if "m" in flags else "")
    # Without the m flag a dollar is the very end only.
    if "m" not in flags:
        body = re.sub(r"(?<!\\)\$", r"\\z", body)
    return on + body


def replacement(text: str) -> str:
    """A replacement checked by the rules of fn:replace; Java's are the same for what passes."""
    if not re.fullmatch(r"(?:[^\\$]|\\[\\$]|\$\d)*", text, re.DOTALL):
        raise XPathError("FORX0004", f"bad replacement {text!r}")
    return text


def may_be_empty(java: str) -> bool:
    """Does the pattern match the empty text? Judged by the regex module, whose syntax is near enough."""
    import regex

    try:
        plain = re.sub(r"\\p\{In[^}]*\}", r"\\p{L}", java).replace(r"\z", r"\Z")
        return regex.search(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), plain.replace("&&[^", "--[")), "", regex.V1) is not None
    except regex.error:
        return False
