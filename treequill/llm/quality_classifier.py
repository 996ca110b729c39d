"""Quality classifier: a factorisation machine over words, structure and length.

A text becomes a sparse vector: hashed words with damped, length-normalised
counts, and dense statistics of its structure and size, standardised on the
training rows. With x its entries, the machine scores

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

which holds the interactions of all pairs of entries but takes time linear in
their number. The driver learns it from the vectors of a bounded sample of
labelled rows; scoring maps over the table with the weights in the closure.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import textvec
from treequill.llm.common import table

#: Labelled rows that the machine is fitted on, about; twice that at most.
TRAIN_ROWS = 6000
#: Hash buckets of words, rank of the interactions, passes, and the optimiser's settings.
BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY = 1 << 12, 8, 12, 128, 0.02, 1e-5

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "symbol": b"#*$%&|<>{}[]\\^~=+_@",
    "exclaim": b"!?",
    "stop": b".,;:",
    "line": b"\n",
    "wide": bytes(range(128, 256)),
}
STATISTICS = ("log_bytes", "log_words", "word_length", *_CLASSES, "distinct", "stutter", "repeat", "top", "long_words")


def _per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def vectors(chunk: textvec.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of each entry, bucket, value) of the words, sorted by row, and the statistics of each row."""
    lens = np.diff(chunk.bounds)
    safe = np.maximum(lens, 1).astype(np.float64)
    rows = chunk.row_of_word()
    # Words by (row, hash): counts of equal words.
    order = np.lexsort((chunk.hashes, rows))
    r, h = rows[order], chunk.hashes[order]
    new = np.ones(len(r), dtype=bool)
    new[1:] = (np.diff(r) != 0) | (h[1:] != h[:-1])
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(r)))
    owner, value = r[heads], np.log1p(counts)
    bucket = (h[heads] >> np.uint64(52)).astype(np.int64)
    norm = np.sqrt(np.bincount(owner, value**2, chunk.rows))
    value = value / np.maximum(norm, 1e-9)[owner]
    # Structure.
    size = np.diff(chunk.offsets)
    letters = np.maximum(_per_row(chunk.end - chunk.start, chunk.bounds), 1)
    stats = [np.log1p(size), np.log1p(lens), letters / safe]
    for members in _CLASSES.values():
        known = np.zeros(256, dtype=bool)
        known[list(members)] = True
        stats.append(_per_row(known[chunk.data], chunk.offsets) / letters)
    stats.append(np.bincount(owner, minlength=chunk.rows) / safe)
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (rows[1:] == rows[:-1])
    stats.append(_per_row(same, chunk.bounds) / safe)
    inside = np.flatnonzero(chunk.inside(3))
    grams, gram_rows = chunk.grams(3)[inside], rows[inside]
    order = np.lexsort((grams, gram_rows))
    grams, gram_rows = grams[order], gram_rows[order]
    again = np.flatnonzero((grams[1:] == grams[:-1]) & (gram_rows[1:] == gram_rows[:-1]))
    stats.append(np.bincount(gram_rows[again], minlength=chunk.rows) / safe)
    top = np.zeros(chunk.rows)
    np.maximum.at(top, owner, counts)
    stats.append(np.maximum(top - 1, 0) / safe)
    stats.append(_per_row(chunk.end - chunk.start > 20, chunk.bounds) / safe)
    return owner, bucket, value.astype(np.float32), np.stack(stats, axis=1).astype(np.float32)


@dataclass
class Machine:
    """Weights of the buckets, then of the statistics; ``mean`` and ``scale`` standardise the latter."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def standard(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.mean) / self.scale, -4, 4)

    def margins(self, owner: np.ndarray, bucket: np.ndarray, value: np.ndarray, stats: np.ndarray) -> np.ndarray:
        """The machine's sums by row, by the sum-of-squares identity."""
        n, dense = len(stats), self.standard(stats)
        tail, tail_factors = self.linear[BUCKETS:], self.factors[BUCKETS:]
        # Sums by row, not matrix products: those may add in another order for another place in a chunk.
        out = self.bias + (dense * tail).sum(axis=1) + np.bincount(owner, self.linear[bucket] * value, n)
        for f in range(self.factors.shape[1]):
            part = self.factors[bucket, f] * value
            whole = dense * tail_factors[:, f]
            sums = np.bincount(owner, part, n) + whole.sum(axis=1)
            squares = np.bincount(owner, part**2, n) + (whole**2).sum(axis=1)
            out += 0.5 * (sums**2 - squares)
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rank: int = RANK, seed: int = 7) -> Machine:
    """A machine from (buckets, values, statistics, label) of each training row, by Adam on the logistic loss. Without rows, one that scores 0.5."""
    width = BUCKETS + len(STATISTICS)
    rng = np.random.default_rng(seed)
    machine = Machine(0.0, np.zeros(width), rng.normal(0, 0.02, (width, rank)), np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)))
    if not rows:
        machine.factors[:] = 0
        return machine
    stats = np.array([r[2] for r in rows], dtype=np.float64)
    labels = np.array([r[3] for r in rows], dtype=np.float64)
    machine.mean, machine.scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-3)
    dense = machine.standard(stats)
    lens = np.array([len(r[0]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(lens)])
    buckets = np.concatenate([r[0] for r in rows]).astype(np.int64)
    values = np.concatenate([r[1] for r in rows]).astype(np.float64)
    tail = np.arange(BUCKETS, width)
    params = np.concatenate([machine.linear[:, None], machine.factors], axis=1)
    first, second, step = np.zeros_like(params), np.zeros_like(params), 0
    bias_first = bias_second = 0.0
    for _ in range(epochs):
        for pick in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // BATCH)):
            at = np.concatenate([np.arange(starts[i], starts[i + 1]) for i in pick])
            owner = np.concatenate([np.repeat(np.arange(len(pick)), lens[pick]), np.repeat(np.arange(len(pick)), len(tail))])
            index = np.concatenate([buckets[at], np.tile(tail, len(pick))])
            x = np.concatenate([values[at], dense[pick].ravel()])
            w = params[index]
            vx = w[:, 1:] * x[:, None]
            m = len(at)
            sums = np.zeros((len(pick), rank))
            np.add.at(sums, owner[:m], vx[:m])
            sums += vx[m:].reshape(len(pick), len(tail), rank).sum(axis=1)
            squares = np.bincount(owner, (vx**2).sum(axis=1), len(pick))
            margin = machine.bias + np.bincount(owner, w[:, 0] * x, len(pick)) + 0.5 * ((sums**2).sum(axis=1) - squares)
            error = (logistic(margin) - labels[pick]) / len(pick)
            grad = np.zeros_like(params)
            scaled = error[owner] * x
            grad[:, 0] = np.bincount(index, scaled, width)
            pair = scaled[:, None] * (sums[owner] - vx)
            for f in range(rank):
                grad[:, f + 1] = np.bincount(index, pair[:, f], width)
            grad += DECAY * params
            step += 1
            first += 0.1 * (grad - first)
            second += 0.001 * (grad**2 - second)
            bias_first += 0.1 * (error.sum() - bias_first)
            bias_second += 0.001 * (error.sum() ** 2 - bias_second)
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            params -= RATE * fix * first / (np.sqrt(second) + 1e-8)
            machine.bias -= RATE * fix * bias_first / (np.sqrt(bias_second) + 1e-8)
    machine.linear, machine.factors = np.ascontiguousarray(params[:, 0]), np.ascontiguousarray(params[:, 1:])
    return machine


def _vector_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in textvec.chunks(textvec.column(batch, "text")):
            owner, bucket, value, stats = vectors(chunk)
            bounds = pa.array(np.searchsorted(owner, np.arange(chunk.rows + 1)).astype(np.int32))
            offs = pa.array(np.arange(chunk.rows + 1, dtype=np.int32) * stats.shape[1])
            cols = [textvec.column(batch, c).slice(chunk.first, chunk.rows) for c in ("doc_id", "label")]
            cols += [pa.ListArray.from_arrays(bounds, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value)), pa.ListArray.from_arrays(offs, pa.array(stats.ravel()))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "label", "bucket", "value", "stats"])


def _score_rows(machine: Machine):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(textvec.column(batch, "text")):
                scores = logistic(machine.margins(*vectors(chunk)))
                yield pa.RecordBatch.from_arrays([textvec.column(batch, "doc_id").slice(chunk.first, chunk.rows), pa.array(scores)], names=["doc_id", "score"])

    return textvec.lean(run)


def held_out(doc_id: str = "doc_id"):
    """The third of the rows that is never learnt from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Machine:
    """Fits on the labelled rows whose doc_id hashes lowest, about ``rows`` of those that aren't held out.

    ``labels`` has doc_id and quality; rows with a null in either, and labels
    without a document, teach nothing. Repeated labels of a document count once:
    the lowest. The sample's ids, ``2 * rows`` at most, are broadcast; its vectors
    go to the driver.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality")
    share = min(1.0, rows / max(1, known.count()))
    lowest = F.xxhash64("doc_id").cast("double") / float(2**63)
    sample = known.where(lowest <= 2 * share - 1).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).limit(2 * rows)
    sample = sample.select(F.col("doc_id").alias("_id"), "label")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("doc_id", "label", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(textvec.lean(_vector_rows), f"doc_id {kind}, label int, bucket array<int>, value array<float>, stats array<float>").toArrow()
    found = found.sort_by("doc_id")
    lists = [[np.asarray(x.values) for x in found.column(c)] for c in ("bucket", "value", "stats")]
    return fit(list(zip(*lists, found.column("label").to_pylist(), strict=True)))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs`` (doc_id, text; others are ignored).

    Null texts score as empty ones: no words, all statistics zero. Equal texts
    score equally, whatever their ids. Empty tables give no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(_score_rows(machine), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` (with a column text) that score 0.5 or more, all columns unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [logistic(machine.margins(*vectors(c))) for c in textvec.chunks(textvec.column(batch, "text"))]
            if found:
                yield batch.filter(pa.array(np.concatenate(found) >= 0.5))

    return docs.mapInArrow(textvec.lean(run), docs.schema)


def op1_fm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
