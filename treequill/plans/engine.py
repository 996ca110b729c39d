"""The engine: documents, names and functions of a session, and queries over them."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treequill.functions import udfs
from treequill.functions.registry import Catalog
from treequill.functions.values import SQL_OF, Val, fresh, of_literal, one
from treequill.plans import within
from treequill.plans.compiler import Compiler, Node, Place, Rel, Row, Static, Table, compiled
from treequill.sources import shred
from treequill.xpath.errors import XPathError
from treequill.xpath.parser import parse


#: Stretches that rows are numbered in where a predicate needs all their positions.
STRETCHES = 64


def _type_of(kind: T.DataType) -> str | None:
    """The XPath type of a column; None for columns that are no simple content."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "integer"
    if isinstance(kind, T.DecimalType):
        return "decimal"
    simple = {T.FloatType: "float", T.DoubleType: "double", T.StringType: "string", T.BooleanType: "boolean", T.DateType: "date", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime"}
    return simple.get(type(kind))


def _cuts(df: DataFrame, column: str, kind: str, stretches: int = STRETCHES):
    """A function that finds, once and only if asked, the quantiles of a numeric column as SQL literals."""
    if kind not in ("integer", "decimal", "double"):
        return None
    found: list[list[str]] = []

    def cuts() -> list[str]:
        if not found:
            row = df.agg(F.percentile_approx(column, [i / stretches for i in range(1, stretches)], 10_000)).first()
            found.append([repr(x) if kind == "double" else f"{x}L" if kind == "integer" else f"cast('{x}' as decimal(38, 18))" for x in sorted(set(row[0] or []))])
        return found[0]

    return cuts


class Engine:
    """XPath over registered tables and XML node tables.

    ``positional`` and ``mode`` are the dialect: see ``Static``.
    """

    def __init__(self, spark: SparkSession, mode: str = "2.0", positional: str = "step", namespaces: Mapping[str, str] | None = None, default_namespace: str = "", base_uri: str | None = None) -> None:
        self.spark = spark
        udfs.register(spark)
        self.static = Static(mode=mode, positional=positional, default_namespace=default_namespace, base_uri=base_uri, catalog=Catalog(mode))
        self.static.namespaces.update(namespaces or {})

    def table(self, name: str, df: DataFrame, order: Sequence[str] = ()) -> Engine:
        """Registers ``df`` as the document /name/row; ``order`` are the columns of a unique key that give document order."""
        columns, select = {}, []
        for f in df.schema.fields:
            kind = _type_of(f.dataType)
            if kind is None:
                continue
            columns[f.name] = kind
            column = df[f"`{f.name}`"]
            if kind == "dateTime":
                column = column.cast("timestamp_ntz")
            elif kind == "integer" and not isinstance(f.dataType, T.LongType):
                column = column.cast("bigint")
            select.append(column.alias(f.name))
        view = fresh(f"tq_{name}")
        plain = df.select(*select)
        plain.createOrReplaceTempView(view)
        bounds = _cuts(plain, order[0], columns[order[0]]) if order else None
        self.static.tables[name] = Table(view, columns, tuple(order), bounds)
        return self

    def nodes(self, df: DataFrame) -> Engine:
        """Registers a node table (see ``treequill.sources.shred``) as the documents of absolute paths."""
        view = fresh("tq_nodes")
        df.createOrReplaceTempView(view)
        self.static.nodes, self.static.documents = view, False
        return self

    def documents(self, df: DataFrame, doc: str = "doc_id", xml: str = "xml") -> Engine:
        """Registers a table of documents (see ``treequill.sources.shred``) as those of absolute paths. Steps are walked where a document is read, see ``treequill.plans.within``; only what these can't tell reads a node table."""
        self.nodes(shred.shred(df, doc, xml))
        self.texts, self.static.documents = df.select(doc, xml), True
        return self

    def register(self, name: str, build: Callable[..., Val], least: int, most: int | None = -1) -> Engine:
        """A custom function, which hides a built-in one of its name."""
        self.static.catalog.register(name, build, least, most)
        return self

    def register_udf(self, name: str, function: Callable, returns: str, count: int) -> Engine:
        """A custom function from a pandas function of ``count`` series; ``returns`` is its result's XPath type."""
        udf = fresh("tq_udf")
        self.spark.udf.register(udf, F.pandas_udf(function, SQL_OF[returns]))
        return self.register(name, lambda *args: Val(f"{udf}({', '.join(one(a).sql for a in args)})", returns), count)

    def variable(self, name: str, value: object) -> Engine:
        """An external variable: a string, number or boolean."""
        kind = "boolean" if isinstance(value, bool) else "integer" if isinstance(value, int) else "double" if isinstance(value, float) else "string" if isinstance(value, str) else "decimal"
        self.static.variables[name] = of_literal(value, kind)
        return self

    def plan(self, text: str) -> Rel | Val:
        return compiled(text, self.static)[1]

    def sql(self, text: str, columns: Sequence[str] = (), ordered: bool = False) -> str:
        """The SQL of an expression. ``columns`` name the members of the sequence that a loop returns, one column each."""
        compiler, plan = compiled(text, self.static)
        sql = self._select(compiler, plan, columns, ordered)
        for alias, asked in compiler.within.items():
            if asked.view in sql:
                read = set(re.findall(rf"\b{alias}\.(\w+)", sql)) if f"{alias}.*" not in sql else {*shred.COLUMNS, *asked.members.values()}
                within.found(self.texts, asked, read).createOrReplaceTempView(asked.view)
        return sql

    def _select(self, compiler: Compiler, plan: Rel | Val, columns: Sequence[str], ordered: bool) -> str:
        if isinstance(plan, Rel) and plan.frm[0] == "(SELECT 1)" and isinstance(plan.item, Val):
            found = f"explode({plan.item.sql})" if plan.item.seq else self._out(plan.item)
            return f"SELECT item FROM ({plan.sql(f'{found} AS item')}) WHERE item IS NOT NULL"
        if isinstance(plan, Val):
            if plan.seq:
                return f"SELECT explode({plan.sql}) AS item"
            return f"SELECT item FROM (SELECT {self._out(plan)} AS item) WHERE item IS NOT NULL"
        item = plan.item
        if columns:
            if plan.members and len(plan.members) == len(columns):
                # The members stand side by side, so the sequence itself is not built.
                base = Rel(tuple(f for f in plan.frm if not f.startswith("LATERAL (SELECT posexplode(") or plan.item.sql.partition(".")[0] not in f), plan.where, item, plan.order)  # type: ignore[union-attr]
                select = ", ".join(f"{self._out(m)} AS `{c}`" for m, c in zip(plan.members, columns, strict=True))
                return base.sql(select)
            if len(columns) == 1:
                return plan.sql(f"{self._out(compiler.atom(plan))} AS `{columns[0]}`")
            raise XPathError("XPTY0004", "the expression has other columns")
        if isinstance(item, Row):
            select = f"{item.alias}.*" if "_pos" not in plan.frm[-1] else f"{item.alias}.* EXCEPT (_pos, _last)"
        elif isinstance(item, Node):
            select = f"{item.alias}.doc, {item.alias}.pre, {item.alias}.kind, {item.alias}.local, {item.alias}.value"
        else:
            select = f"{self._out(item)} AS item"
        tail = f" ORDER BY {', '.join(f'{o} DESC' if plan.reverse and not isinstance(item, Node) else o for o in plan.order)}" if ordered and plan.order else ""
        return plan.sql(select, tail)

    def _out(self, v: Val) -> str:
        """A result column: temporal values with an offset and durations as their text."""
        from treequill.functions.values import as_text

        if v.tz is not None or v.type in ("time", "yearMonth", "dayTime", "duration", "QName"):
            return as_text(v)
        return v.sql if v.type in SQL_OF else f"cast({v.sql} as string)"

    def query(self, text: str, columns: Sequence[str] = (), ordered: bool = False) -> DataFrame:
        """The items of an expression as rows: ``item``, or the columns of table rows and nodes."""
        return self.spark.sql(self.sql(text, columns, ordered))

    # Results of one kind.

    def run_boolean(self, text: str) -> bool:
        found = self.query(f"boolean({text})").first()
        return bool(found and found[0])

    def run_string(self, text: str) -> str:
        found = self.query(f"string({text})").first()
        return found[0] if found else ""

    def run_number(self, text: str) -> float:
        found = self.query(f"number({text})").first()
        return float(found[0]) if found else float("nan")

    def column(self, text: str, table: str) -> str:
        """The SQL of an expression in the row of a registered table, whose columns it names directly."""
        compiler = Compiler(self.static)
        item = Row(self.static.tables[table].view, table)
        return compiler.value(parse(text, self.static.mode), Place(self.static, item=item, vars=dict(self.static.variables))).sql
