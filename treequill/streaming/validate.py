"""Documents and rows that keep arriving: shredding and validation over Structured Streaming.

Shredding and facet checks are stateless and run on the stream itself. Whole
validation has joins and iterations, so it runs on each micro-batch: a document is
in one batch, and no rule looks beyond its document. Batches are written with
their number, so a batch that is run again after a failure replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.query import StreamingQuery

from treequill.operators import facets
from treequill.sources import shred
from treequill.xsd.schema import Schema
from treequill.xsd.validate import Options, validate


def nodes(stream: DataFrame, doc: str = "doc_id", xml: str = "xml") -> DataFrame:
    """The stream of node rows of a stream of documents."""
    return shred.shred(stream, doc, xml)


def check(stream: DataFrame, column: str, kind: facets.Simple, keys: list[str]) -> DataFrame:
    """The stream of (keys, value, code) of rows whose value breaks a simple type."""
    return facets.check_column(stream, column, kind, keys)


def validated(stream: DataFrame, schema: Schema, path: str, checkpoint: str, options: Options = Options(), doc: str = "doc_id", xml: str = "xml", trigger: dict | None = None) -> StreamingQuery:  # noqa: B008
    """Starts a query that appends each batch's violations to ``path``/violations and its typed elements to ``path``/psvi."""

    def batch(df: DataFrame, number: int) -> None:
        table = shred.shred(df, doc, xml).persist()
        try:
            found = validate(df.sparkSession, table, schema, options)
            for name, rows in (("violations", found.violations), ("psvi", found.psvi)):
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            table.unpersist()

    writer = stream.select(doc, xml).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
