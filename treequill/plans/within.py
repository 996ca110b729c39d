"""Paths that stay in a document, in one pass over each document.

A document is shredded where it is read and its paths are walked there, so
nothing is exchanged or broadcast, and only the nodes found come out, with what
is wanted of the paths below them. The nodes of a node table are brought
together by document first: one exchange, however many paths. A step costs about
the nodes it looks at: each finds a document's nodes once, in document order. As
in shredding, a worker holds one document. One that is not well-formed has no
nodes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treequill.plans.lineage import ship
from treequill.sources import shred
from treequill.xpath.parser import REVERSE

#: Rows of a batch that comes out.
ROWS = 20_000


@dataclass(frozen=True)
class Hop:
    """A step: an axis, what kind and name it asks for (None: any), and the places it keeps, one after another (-1: the last)."""

    axis: str
    kind: str | None = None
    ns: str | None = None
    local: str | None = None
    places: tuple[int, ...] = ()


@dataclass
class Within:
    """What is asked of each document: the nodes at the end of ``hops``, and by column the count or the values at the end of more hops from each.

    ``marked``: the nodes of a node table instead whose column of that name is true.
    """

    view: str
    hops: tuple[Hop, ...] = ()
    members: dict[tuple[str, tuple], str] = field(default_factory=dict)
    marked: str | None = None

    def member(self, what: str, hops: tuple) -> str:
        """``what``: "count", "values", "typed" (values with whether their types are numbers'), or "tuples" (nodes at the end of the first branches, with the typed values of each of the other branches)."""
        return self.members.setdefault((what, hops), f"_m{len(self.members)}")


class Tree:
    """The nodes of one document, by number."""

    def __init__(self, of: dict[str, list]) -> None:
        self.kind, self.ns, self.local, self.value, self.parent, self.post, self.types = (of[c] for c in ("kind", "ns", "local", "value", "parent", "post", "types"))
        if of["pre"][-1] != len(self.kind) - 1:  # of a part of a node table
            at = {pre: n for n, pre in enumerate(of["pre"])}
            self.parent, self.post = [at.get(p) for p in self.parent], [bisect_right(of["pre"], p) - 1 for p in self.post]
        self.inside: list[list[int]] = [[] for _ in self.kind]
        for n, parent in enumerate(self.parent):
            if parent is not None:
                self.inside[parent].append(n)
        self.leaf = [k in ("attribute", "namespace") for k in self.kind]

    def walk(self, found: list[int], hops: tuple[Hop, ...]) -> list[int]:
        for hop in hops:
            found = self.hop(found, hop)
        return found

    def hop(self, found: list[int], hop: Hop) -> list[int]:
        reached = self.reached(found, hop.axis)
        if hop.kind is not None:
            kind, local, ns = hop.kind, hop.local, hop.ns
            reached = [n for n in reached if self.kind[n] == kind and (local is None or self.local[n] == local) and (ns is None or self.ns[n] == ns)]
        for place in hop.places:
            at = len(reached) if place == -1 else place
            if hop.axis in REVERSE:
                at = len(reached) + 1 - at
            reached = reached[at - 1 : at] if at > 0 else []
        return reached

    def reached(self, found: list[int], axis: str) -> list[int]:
        """The nodes on an axis of some of the nodes ``found``, in document order, once each."""
        leaf, post, parent = self.leaf, self.post, self.parent
        if not found or axis == "self":
            return found
        if axis in ("attribute", "namespace"):
            return sorted(n for a in found for n in self.inside[a] if self.kind[n] == axis)
        if axis == "child":
            return sorted(n for a in found for n in self.inside[a] if not leaf[n])
        if axis == "parent":
            return sorted({parent[a] for a in found if parent[a] is not None})
        if axis in ("ancestor", "ancestor-or-self"):
            out = set()
            for a in found:
                up = parent[a]
                while up is not None and up not in out:
                    out.add(up)
                    up = parent[up]
            return sorted(out | set(found) if axis == "ancestor-or-self" else out)
        if axis in ("descendant", "descendant-or-self"):
            own = set(found) if axis == "descendant-or-self" else ()
            out, end = [], -1
            for a in found:  # what lies in a node before has been found with that
                if a > end:
                    out += [n for n in range(a, post[a] + 1) if n in own or n > a and not leaf[n]]
                    end = post[a]
            return out
        if axis in ("following-sibling", "preceding-sibling"):
            ends: dict[int, int] = {}
            for a in found:
                if parent[a] is not None and not leaf[a]:
                    ends.setdefault(parent[a], a)
                    if axis == "preceding-sibling":
                        ends[parent[a]] = a  # the last of them
            after = axis == "following-sibling"
            return sorted(n for p, a in ends.items() for n in self.inside[p] if not leaf[n] and (n > a if after else n < a))
        if axis == "following":
            return [n for n in range(min(post[a] for a in found) + 1, len(leaf)) if not leaf[n]]
        return [n for n in range(found[-1]) if not leaf[n] and post[n] < found[-1]]


    def either(self, found: list[int], branches: tuple[tuple[Hop, ...], ...]) -> list[int]:
        if len(branches) == 1:
            return self.walk(found, branches[0])
        return sorted({n for hops in branches for n in self.walk(found, hops)})

    def typed(self, found: list[int]) -> list[dict]:
        return [{"v": self.value[n], "n": not NUMBERS.isdisjoint(self.types[n] or ())} for n in found]

    def member(self, what: str, hops: tuple, n: int) -> object:
        if what == "tuples":
            return [{"pre": x, **{f"f{i}": self.typed(self.either([x], f)) for i, f in enumerate(hops[1:])}} for x in self.either([n], hops[0])]
        found = self.walk([n], hops)
        return len(found) if what == "count" else self.typed(found) if what == "typed" else [self.value[x] for x in found]


NUMBERS = {"decimal", "float", "double"}
TYPED = "array<struct<v: string, n: boolean>>"
#: Columns of a node table that walks need.
NEEDED = ("doc", "pre", "post", "parent", "kind", "ns", "local", "value", "types")


def _type(what: str, hops: tuple) -> str:
    if what == "tuples":
        return f"array<struct<pre: int{''.join(f', f{i}: {TYPED}' for i in range(len(hops) - 1))}>>"
    return {"count": "bigint", "values": "array<string>", "typed": TYPED}[what]


class _Out:
    """Rows of what is found, by column."""

    def __init__(self, within: Within, arrow: pa.Schema) -> None:
        self.within, self.arrow = within, arrow
        self.members = [(what, hops, name) for (what, hops), name in within.members.items() if name in arrow.names]
        self.plain = [c for c in arrow.names if c in shred.COLUMNS]
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, list] = {c: [] for c in self.arrow.names}

    def add(self, nodes: dict[str, list]) -> None:
        if nodes["kind"][0] == "error":
            return
        tree = Tree(nodes)
        if self.within.marked is None:
            found = tree.walk([n for n in (0,) if tree.kind[n] == "document"], self.within.hops)
        else:
            found = [n for n, mark in enumerate(nodes[self.within.marked]) if mark]
        for c in self.plain:
            values = nodes[c]
            self.of[c] += [values[n] for n in found]
        for what, hops, name in self.members:
            self.of[name] += [tree.member(what, hops, n) for n in found]

    def batch(self) -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(self.of[f.name], f.type) for f in self.arrow], schema=self.arrow)
        self.clear()
        return out


def _of_texts(within: Within, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(within, arrow)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                nodes = shred._Columns()
                try:
                    shred.shred_into(nodes, doc, shred.decode(text) if isinstance(text, bytes) else text)
                except (shred.NotWellFormed, UnicodeDecodeError):
                    continue
                out.add(nodes.of)
                if len(out.of["doc"]) > ROWS:
                    yield out.batch()
            yield out.batch()

    return run


def _of_nodes(within: Within, arrow: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rest = _Out(within, arrow), None
        for batch in batches:
            names, columns = batch.schema.names, [c.to_pylist() for c in batch.columns]
            docs, start = columns[names.index("doc")], 0
            while start < len(docs):
                end = start
                while end < len(docs) and docs[end] == docs[start]:
                    end += 1
                part = {c: values[start:end] for c, values in zip(names, columns, strict=True)}
                if rest is not None and rest["doc"][0] == docs[start]:
                    for c, values in rest.items():
                        values += part[c]
                else:
                    if rest is not None:
                        out.add(rest)
                    rest = part
                start = end
            if len(out.of["doc"]) > ROWS:
                yield out.batch()
        if rest is not None:
            out.add(rest)
        yield out.batch()

    return run


def _schema(doc: T.DataType, within: Within, columns: set[str]) -> T.StructType:
    members = [f"{name} {_type(what, hops)}" for (what, hops), name in within.members.items()]
    fields = T._parse_datatype_string(", ".join([shred.SCHEMA.format(doc=doc.simpleString()), *members])).fields
    return T.StructType([f for f in fields if f.name == "doc" or f.name in columns])


def found(docs: DataFrame, within: Within, columns: set[str]) -> DataFrame:
    """The node rows that ``within`` asks of documents (doc, text), of the columns named and ``doc``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(docs.sparkSession)
    schema = _schema(docs.schema.fields[0].dataType, within, columns)
    return docs.mapInArrow(_of_texts(within, to_arrow_schema(schema)), schema)


def found_in(nodes: DataFrame, within: Within, columns: set[str]) -> DataFrame:
    """The same of a node table."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(nodes.sparkSession)
    schema = _schema(nodes.schema["doc"].dataType, within, columns)
    wanted = dict.fromkeys([*NEEDED, *(c for c in schema.names if c in shred.COLUMNS), *([within.marked] if within.marked else [])])
    together = nodes.where(F.col("doc").isNotNull()).select(*wanted).repartition("doc").sortWithinPartitions("doc", "pre")
    return together.mapInArrow(_of_nodes(within, to_arrow_schema(schema)), schema)
