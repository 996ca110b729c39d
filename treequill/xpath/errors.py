"""XPath errors by code."""

from __future__ import annotations


class XPathError(ValueError):
    """An error that the language names by a code such as XPST0003."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code
