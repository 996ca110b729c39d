"""XML documents as node tables.

``shred`` makes a row of every node of every document: document, element,
attribute, namespace, text, comment and processing instruction. ``pre`` numbers
the nodes of a document in document order, ``post`` is the last number in a
node's subtree, attributes and namespaces included, so every axis is a comparison
of numbers within a document. Documents are parsed on the executors, each by an
event parser in one pass; a document that is not well-formed becomes one row of
kind ``error`` that carries the parser's message.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treequill.plans.lineage import ship

XML = "http://www.w3.org/XML/1998/namespace"
XSI = "http://www.w3.org/2001/XMLSchema-instance"
COLUMNS = ("doc", "pre", "post", "parent", "depth", "kind", "ns", "prefix", "local", "value", "path", "ns_bindings", "xml_id", "base_uri", "lang", "is_nil", "line", "types")
SCHEMA = (
    "doc {doc}, pre int, post int, parent int, depth int, kind string, ns string, prefix string, local string, value string, path string, "
    "ns_bindings map<string,string>, xml_id string, base_uri string, lang string, is_nil boolean, line int, types array<string>"
)


class NotWellFormed(ValueError):
    pass


def decode(data: bytes) -> str:
    """Text of XML bytes: by byte order mark, else by the zero bytes of UTF-16, else by the declaration."""
    if data[:3] == b"\xef\xbb\xbf":
        return data[3:].decode("utf-8")
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return data.decode("utf-16")
    if data[:2] == b"<\0":
        return data.decode("utf-16-le")
    if data[:2] == b"\0<":
        return data.decode("utf-16-be")
    head = data[:200].split(b"?>")[0]
    name = head.partition(b"encoding=")[2][1:].split(b'"')[0].split(b"'")[0].decode("ascii", "replace") if head.startswith(b"<?xml") else ""
    try:
        return data.decode(name or "utf-8")
    except LookupError as e:
        raise NotWellFormed(f"unknown encoding {name}") from e


class _Columns:
    """Node rows of many documents, by column."""

    def __init__(self) -> None:
        self.of: dict[str, list] = {name: [] for name in COLUMNS}

    def __len__(self) -> int:
        return len(self.of["pre"])

    def cut(self, size: int) -> None:
        for values in self.of.values():
            del values[size:]

    def error(self, doc: object, message: str, line: int | None) -> None:
        row = {"doc": doc, "pre": 0, "post": 0, "depth": 0, "kind": "error", "ns": "", "prefix": "", "local": "", "value": message, "path": "", "is_nil": False, "line": line}
        for name, values in self.of.items():
            values.append(row.get(name))

    def rows(self) -> list[dict]:
        return [dict(zip(COLUMNS, row, strict=True)) for row in zip(*self.of.values(), strict=True)]


class _Shredder:
    """Appends the rows of one document from parser events. A frame is an open element: its place, text parts, path, base URI and language."""

    def __init__(self, columns: _Columns, doc: object, base: str | None, parser) -> None:
        self.columns, self.of, self.doc, self.parser = columns, columns.of, doc, parser
        self.first = len(columns)
        self.text: list[str] = []
        scope = {"xml": XML}
        self.scopes = [(scope, list(scope.items()))]
        self.stack: list[tuple[int, list[str], str, str | None, str | None]] = []
        self.add("document", "", "", "", None, "", base, None, None)
        self.stack.append((0, [], "", base, None))

    def add(self, kind: str, ns: str, prefix: str, local: str, value: str | None, path: str, base: str | None, lang: str | None, bindings: list | None) -> int:
        of, pre = self.of, len(self.of["pre"]) - self.first
        of["doc"].append(self.doc)
        of["pre"].append(pre)
        of["post"].append(pre)
        of["parent"].append(self.stack[-1][0] if self.stack else None)
        of["depth"].append(len(self.stack))
        of["kind"].append(kind)
        of["ns"].append(ns)
        of["prefix"].append(prefix)
        of["local"].append(local)
        of["value"].append(value)
        of["path"].append(path)
        of["ns_bindings"].append(bindings)
        of["xml_id"].append(None)
        of["base_uri"].append(base)
        of["lang"].append(lang)
        of["is_nil"].append(False)
        of["line"].append(self.parser.CurrentLineNumber)
        of["types"].append(None)
        return pre

    def leaf(self, kind: str, local: str, value: str) -> None:
        _, _, path, base, lang = self.stack[-1]
        self.add(kind, "", "", local, value, path, base, lang, None)

    def characters(self, value: str) -> None:
        self.text.append(value)

    def flush(self) -> None:
        if self.text:
            value = "".join(self.text)
            self.text = []
            if len(self.stack) > 1:
                self.leaf("text", "", value)
                for frame in self.stack:
                    frame[1].append(value)

    def qname(self, name: str, element: bool) -> tuple[str, str, str]:
        prefix, _, local = name.rpartition(":")
        scope = self.scopes[-1][0]
        if not prefix:
            return (scope.get("", "") if element else ""), "", local
        if prefix not in scope:
            raise NotWellFormed(f"unbound prefix {prefix}")
        return scope[prefix], prefix, local

    def start(self, name: str, attributes: list[str]) -> None:
        if self.text:
            self.flush()
        declared = {}
        if attributes:
            declared = {n[6:]: v for n, v in zip(attributes[::2], attributes[1::2], strict=True) if n == "xmlns" or n.startswith("xmlns:")}
        if declared:
            scope = {k: v for k, v in {**self.scopes[-1][0], **declared}.items() if v}
            self.scopes.append((scope, list(scope.items())))
        else:
            self.scopes.append(self.scopes[-1])
        _, _, above, base, lang = self.stack[-1]
        ns, prefix, local = self.qname(name, True)
        path = f"{above}/{local}"
        pre = self.add("element", ns, prefix, local, None, path, base, lang, self.scopes[-1][1])
        here, of = self.first + pre, self.of
        parts: list[str] = []
        self.stack.append((pre, parts, path, base, lang))
        for p, uri in declared.items():
            self.add("namespace", "", "", p, uri, path, base, lang, None)
        seen = set()
        for i in range(0, len(attributes), 2):
            n, v = attributes[i], attributes[i + 1]
            if n == "xmlns" or n.startswith("xmlns:"):
                continue
            ns, prefix, local = self.qname(n, False)
            if (ns, local) in seen:
                raise NotWellFormed(f"attribute {n} twice")
            seen.add((ns, local))
            self.add("attribute", ns, prefix, local, v, f"{path}/@{local}", base, lang, None)
            if ns == XML and local == "id":
                of["xml_id"][here] = " ".join(v.split())
            elif ns == XML and local == "lang":
                lang = of["lang"][here] = v
            elif ns == XML and local == "base":
                base = of["base_uri"][here] = urljoin(base or "", v)
            elif ns == XSI and local == "nil":
                of["is_nil"][here] = v.strip() in ("true", "1")
        self.stack[-1] = (pre, parts, path, base, lang)

    def end(self, name: str) -> None:
        if self.text:
            self.flush()
        pre, parts, *_ = self.stack.pop()
        self.scopes.pop()
        here = self.first + pre
        self.of["value"][here] = "".join(parts)
        self.of["post"][here] = len(self.columns) - self.first - 1

    def comment(self, value: str) -> None:
        self.flush()
        self.leaf("comment", "", value)

    def instruction(self, target: str, value: str) -> None:
        self.flush()
        self.leaf("pi", target, value)

    def close(self) -> None:
        self.of["value"][self.first] = "".join(self.stack[0][1])
        self.of["post"][self.first] = len(self.columns) - self.first - 1


def shred_into(columns: _Columns, doc: object, text: str | None, base: str | None = None) -> None:
    """Appends the rows of one document; one row of kind ``error`` if it is not well-formed."""
    size = len(columns)
    parser = expat.ParserCreate("utf-8")  # texts are decoded already, whatever they declare
    shredder = _Shredder(columns, doc, base, parser)
    parser.ordered_attributes = True
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = shredder.start, shredder.end
    parser.CharacterDataHandler = shredder.characters
    parser.CommentHandler, parser.ProcessingInstructionHandler = shredder.comment, shredder.instruction
    parser.EntityDeclHandler = _refuse
    try:
        parser.Parse((text or "").encode(), True)
    except (expat.ExpatError, NotWellFormed) as e:
        columns.cut(size)
        columns.error(doc, str(e), parser.CurrentLineNumber)
        return
    shredder.close()


def shred_text(doc: object, text: str | None, base: str | None = None) -> list[dict]:
    """The rows of one document as dictionaries."""
    columns = _Columns()
    shred_into(columns, doc, text, base)
    return columns.rows()


def _refuse(name: str, *rest: object) -> None:
    """Declared entities could expand without bound."""
    raise NotWellFormed(f"entity {name} is declared")


def _rows(schema: pa.Schema):
    def batch_of(columns: _Columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns.of[f.name], f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _Columns()
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    shred_into(columns, doc, decode(text) if isinstance(text, bytes) else text)
                except (NotWellFormed, UnicodeDecodeError) as e:
                    columns.error(doc, str(e), None)
                if len(columns) > 20_000:
                    yield batch_of(columns)
                    columns = _Columns()
            yield batch_of(columns)

    return run


def shred(docs: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """The node table of a table of documents: ``doc`` names them, ``xml`` has their text or bytes. Null is not well-formed."""
    ship(docs.sparkSession)
    kind = docs.schema[doc].dataType
    spark_schema = T._parse_datatype_string(SCHEMA.format(doc=kind.simpleString()))
    from pyspark.sql.pandas.types import to_arrow_schema

    return docs.select(doc, xml).mapInArrow(_rows(to_arrow_schema(spark_schema)), spark_schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The node table of XML files, named by their paths."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("xml"))
    return shred(files)


def errors(nodes: DataFrame) -> DataFrame:
    """(doc, line, message) of the documents that are not well-formed."""
    return nodes.where("kind = 'error'").select("doc", "line", F.col("value").alias("message"))


# Sinks.


def serialize(nodes: DataFrame) -> DataFrame:
    """(doc, xml) of each document of a node table: the markup of its nodes in document order.

    A node contributes text where it starts and, for elements, where it ends;
    both are ordered by the numbers of the node table, so a document is one
    ordered aggregation.
    """
    escape = lambda c, *more: _escaped(c, more)
    name = F.concat_ws(":", F.nullif(F.col("prefix"), F.lit("")), F.col("local"))
    inner = (
        F.when(F.col("kind") == "element", F.concat(F.lit("<"), name))
        .when(F.col("kind") == "namespace", F.concat(F.lit(" xmlns"), F.when(F.col("local") != "", F.concat(F.lit(":"), "local")).otherwise(""), F.lit('="'), escape(F.col("value"), '"'), F.lit('"')))
        .when(F.col("kind") == "attribute", F.concat(F.lit(" "), name, F.lit('="'), escape(F.col("value"), '"'), F.lit('"')))
        .when(F.col("kind") == "text", escape(F.col("value")))
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "value", F.lit("-->")))
        .when(F.col("kind") == "pi", F.concat(F.lit("<?"), "local", F.lit(" "), "value", F.lit("?>")))
    )
    inside = F.col("kind").isin("attribute", "namespace")
    heads = nodes.where(inside).groupBy("doc", "parent").agg(F.max("pre").alias("_last")).select(F.col("doc").alias("_d"), F.col("parent").alias("_p"), "_last")
    met = nodes.where(~F.col("kind").isin("document", "error")).join(heads, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")) & (F.col("kind") == "element"), "left")
    starts = met.select("doc", F.col("pre").alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), inner.alias("s"))
    element = met.where("kind = 'element'")
    closes = element.select("doc", F.coalesce("_last", "pre").alias("a"), F.lit(1).alias("b"), F.lit(0).alias("c"), F.lit(">").alias("s"))
    ends = element.select("doc", F.col("post").alias("a"), F.lit(2).alias("b"), (-F.col("pre")).alias("c"), F.concat(F.lit("</"), name, F.lit(">")).alias("s"))
    parts = starts.union(closes).union(ends)
    return parts.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "c", "s"))), lambda x: x["s"]), "").alias("xml"))


def _escaped(column, more: tuple[str, ...]):
    out = F.replace(F.replace(F.replace(column, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;")) if '"' in more else out


def from_rows(df: DataFrame, key: str, row_tag: str = "row") -> DataFrame:
    """(doc_id, xml) of each row of a table: a document of an element for each column that isn't null."""
    cells = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"<{c}>"), _escaped(F.col(c).cast("string"), ()), F.lit(f"</{c}>"))).otherwise("") for c in df.columns]
    return df.select(F.col(key).alias("doc_id"), F.concat(F.lit(f"<{row_tag}>"), *cells, F.lit(f"</{row_tag}>")).alias("xml"))
