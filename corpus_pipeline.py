"""The corpus pipeline: five stages from raw documents to token ids.

Each stage reads what the one before it wrote. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import mixing, ngram_join, pieces, quality_classifier, substring_dedup
from treequill.llm.common import checkpoint_root, ship, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the factorisation machine rejects."""
    ship(spark)
    machine = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, machine)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the least doc_id."""
    ship(spark)
    return ngram_join.representatives(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes passages out of texts that an earlier document, or the text itself, already has. No document goes."""
    ship(spark)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    parsed = substring_dedup.parse(docs, keep=others)
    columns = {"text": F.col("kept_text"), "doc_id": F.col("doc_id"), "n_chars": F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)}
    columns |= {c: F.col(f"keep_{i}") for i, c in enumerate(others)}
    return parsed.select(*[columns[c].alias(c) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the documents in the order of the Pfair stream, so that a file holds a stretch of it with the target mix."""
    ship(spark)
    return mixing.mix_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, slot, block_row, ids, n_tokens, round_trip): token ids of each text and its place in the stream.

    Files read again may come in any order, so the places are found anew, from
    the same rows and so the same. The stream is the order of (slot, block_row).
    """
    ship(spark)
    placed = mixing.mix(docs, keep=["text"])
    # Encoding hands doc_id through as it is, so the place travels in it.
    whole = placed.select(F.struct("doc_id", "slot", "block_row").alias("doc_id"), "text")
    return pieces.encode(whole, pieces.read_model(pieces.MODEL_PATH)).select("doc_id.*", "ids", "n_tokens", "round_trip")


STAGES = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("substring dedup", without_repeats),
    ("mixing sources to target weights", mixed),
    ("SentencePiece encoding and decoding", tokens),
]

#: A learnt classifier and token paths have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    root = f"{checkpoint_root(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{root}/{i}")
            docs = spark.read.parquet(f"{root}/{i}")
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
