"""The function library: name -> arity and a builder of SQL from argument values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from treequill.functions.values import Val
from treequill.xpath.errors import XPathError


@dataclass(frozen=True)
class Function:
    name: str
    least: int
    most: int | None
    build: Callable[..., Val]
    #: "values": gets argument values. "context": also the place of evaluation, as the first argument.
    needs: str = "values"


FUNCTIONS: dict[str, Function] = {}
#: The functions of XPath 1.0.
OLD = set(
    "last position count id local-name namespace-uri name string concat starts-with contains substring-before substring-after substring string-length "
    "normalize-space translate boolean not true false lang number sum floor ceiling round".split()
)


def function(name: str, least: int, most: int | None = -1, needs: str = "values"):
    """Registers a builder under a name, for ``least`` to ``most`` arguments (None: any number)."""

    def add(build: Callable[..., Val]) -> Callable[..., Val]:
        FUNCTIONS[name] = Function(name, least, least if most == -1 else most, build, needs)
        return build

    return add


class Catalog:
    """Functions by name: custom ones stand before the library's."""

    def __init__(self, mode: str = "2.0") -> None:
        self.mode, self.custom = mode, {}  # type: ignore[var-annotated]

    def register(self, name: str, build: Callable[..., Val], least: int, most: int | None = -1) -> None:
        """A custom function: ``build`` makes a value of argument values, as a SQL text or a call of a registered Spark UDF."""
        self.custom[name] = Function(name, least, least if most == -1 else most, build)

    def find(self, name: str, count: int) -> Function:
        found = self.custom.get(name)
        if found is None:
            local = name.removeprefix("fn:")
            found = FUNCTIONS.get(local)
            if found is not None and self.mode == "1.0" and local not in OLD:
                found = None
        if found is None or count < found.least or found.most is not None and count > found.most:
            raise XPathError("XPST0017", f"no function {name} with {count} arguments")
        return found
