"""Relative Lempel-Ziv parsing of documents against the corpus.

The reference is the corpus itself, in order of (doc_id, word), cut into blocks
by hash. A document is parsed from left to right into factors (start, length,
source document, source start) and literals between them; a source lies earlier
than its factor, so factors and literals rebuild the texts in order. Only matches
of ``WINDOW`` words or more count, and their factors are the duplicate spans.

1. *Anchors.* Of the ``SEED``-word seeds in a window the least hash is its
   anchor (a minimizer), so equal windows have equal anchors. A block counts the
   occurrences of each anchor. A window whose anchor occurs once in the corpus
   is a literal for certain; documents get the list of those anchors back.
2. *Windows.* The other windows are indexed by a 96-bit hash of their words; a
   block answers the earliest place of each. A document gets back which of its
   windows are earliest; every other indexed window is a copy.
3. *Probes.* A stretch of copied windows is looked up at its first and last
   window and where the anchor changes, so probes are less than a window apart.
   The block that has a probe's window answers its earliest place.
4. *Factors.* A factor goes on while the next probe's source is as far on as the
   probe itself: the two windows overlap or touch, so all words between them are
   the source's, too. Else it ends with its last probe's window, a boundary that
   the probe has checked, and the next factor begins behind it.

A factor's source is where its windows stand first, not where the longest match
is: another place may match for longer. The words under factors are the same.

Both indexes aggregate map-side, so a passage that a third of all rows share
costs a block one row for each map task, and no group is ever gathered. Probes of
the commonest ``HOT_SHARE`` windows meet a broadcast of those and are then dealt by
their own places; a window beyond them has at most one ``HOT_SHARE``-th of all.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import textvec
from treequill.llm.common import HOT_LEAST, HOT_SHARE, table

WINDOW = 20
SEED = 8
#: Stands for a null doc_id.
LAST = (1 << 63) - 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the leftmost least value in each stretch of ``width`` values."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, dtype=np.int64)
    place = np.arange(len(values), dtype=np.int64)
    span = 1
    while 2 * span <= width:
        right = values[span:] < values[:-span]
        place = np.where(right, place[span:], place[:-span])
        values = np.where(right, values[span:], values[:-span])
        span *= 2
    rest = width - span
    if rest:
        right = values[rest:] < values[:-rest]
        place = np.where(right, place[rest:], place[:-rest])
    return place[:count]


def _windows(chunk: textvec.Chunk, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one row, the place of each one's anchor, and the seeds' hashes."""
    seeds = chunk.grams(seed)
    starts = np.flatnonzero(chunk.inside(window))
    if len(starts) == 0:
        return starts, starts, seeds
    return starts, _least(seeds, window - seed + 1)[starts], seeds


def _anchor_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = textvec.column(batch, "doc_id")
            for chunk in textvec.chunks(textvec.column(batch, "text")):
                starts, anchors, seeds = _windows(chunk, window, seed)
                places = anchors[np.flatnonzero(np.diff(anchors, prepend=-1))]
                rows = chunk.row_of_word()[places] + chunk.first
                yield pa.RecordBatch.from_arrays([pa.array(seeds[places].view(np.int64)), ids.take(pa.array(rows))], names=["anchor", "doc_id"])

    return textvec.lean(run)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list<long> column; null is an empty list."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.concatenate([[0], np.cumsum(lengths)]), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _per_row(chunk: textvec.Chunk, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chunk's list entries: row (from 0) and value of each."""
    lo, hi = offsets[chunk.first], offsets[chunk.first + chunk.rows]
    counts = np.diff(offsets[chunk.first : chunk.first + chunk.rows + 1])
    return np.repeat(np.arange(chunk.rows, dtype=np.int64), counts), values[lo:hi]


def _member(rows: np.ndarray, keys: np.ndarray, of_rows: np.ndarray, of_keys: np.ndarray) -> np.ndarray:
    """Of each (row, key): is it among the (of_row, of_key)?"""
    salt = lambda r: r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.isin(keys.view(np.uint64) ^ salt(rows), of_keys.view(np.uint64) ^ salt(of_rows))


def _candidates(chunk: textvec.Chunk, singles: tuple[np.ndarray, np.ndarray], window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start word in the chunk, place of the anchor) of the windows whose anchor isn't the only one of its kind."""
    starts, anchors, seeds = _windows(chunk, window, seed)
    if len(starts) == 0:
        return starts, starts, starts
    heads = np.flatnonzero(np.diff(anchors, prepend=-1))
    places = anchors[heads]
    rows = chunk.row_of_word()
    lone = _member(rows[places], seeds[places].view(np.int64), *singles)
    keep = np.repeat(~lone, np.diff(np.append(heads, len(starts))))
    return rows[starts[keep]], starts[keep], anchors[keep]


def _tag(places: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A window's place in its document with 32 bits of its hash."""
    return ((places.astype(np.uint64) << np.uint64(32)) | (first & np.uint64(0xFFFFFFFF))).view(np.int64)


def _packed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text deflated: texts are what most of the exchange is."""
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            yield pa.RecordBatch.from_arrays([*part.columns[:at], _deflated(part.column(at)), *part.columns[at + 1 :]], names=part.schema.names)


def _deflated(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.compress(t, 1) for t in texts.cast(pa.binary()).to_pylist()], pa.binary())


def _texts(batch: pa.RecordBatch) -> pa.Array:
    raw = [b"" if t is None else zlib.decompress(t) for t in textvec.column(batch, "text").to_pylist()]
    return pa.array(raw, pa.large_binary()).cast(pa.large_string())


def _window_rows(window: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = textvec.column(batch, "doc_id")
            offsets, values = _lists(textvec.column(batch, "singles"))
            for chunk in textvec.chunks(_texts(batch)):
                rows, starts, _ = _candidates(chunk, _per_row(chunk, offsets, values), window, seed)
                if len(starts) == 0:
                    continue
                one, two = chunk.grams(window)[starts], (chunk.second_grams(window)[starts] >> np.uint64(32)).astype(np.uint32)
                # Within a document only the earliest of equal windows can be the corpus's earliest.
                order = np.lexsort((starts, two, one, rows))
                new = np.ones(len(order), dtype=bool)
                new[1:] = (np.diff(rows[order]) != 0) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
                pick = np.sort(order[new])
                rows, starts, one, two = rows[pick], starts[pick], one[pick], two[pick]
                places = (starts - chunk.bounds[rows]).astype(np.int32)
                cols = [pa.array(one.view(np.int64)), pa.array(two.view(np.int32)), ids.take(pa.array(rows + chunk.first)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(cols, names=["w1", "w2", "doc_id", "place"])

    return textvec.lean(run)


def _probe_rows(window: int, seed: int):
    """The copied windows of each row that are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = textvec.column(batch, "doc_id")
            single_lists, first_lists = _lists(textvec.column(batch, "singles")), _lists(textvec.column(batch, "firsts"))
            for chunk in textvec.chunks(_texts(batch)):
                rows, copies, anchors = _candidates(chunk, _per_row(chunk, *single_lists), window, seed)
                if len(copies) == 0:
                    continue
                grams = chunk.grams(window)
                copied = ~_member(rows, _tag(copies - chunk.bounds[rows], grams[copies]), *_per_row(chunk, *first_lists))
                rows, copies, anchors = rows[copied], copies[copied], anchors[copied]
                apart = np.diff(copies) != 1
                probe = np.ones(len(copies), dtype=bool)
                probe[1:-1] = apart[:-1] | apart[1:] | (np.diff(anchors)[:-1] != 0)
                rows, copies = rows[probe], copies[probe]
                two = (chunk.second_grams(window)[copies] >> np.uint64(32)).astype(np.uint32)
                places = (copies - chunk.bounds[rows]).astype(np.int32)
                cols = [pa.array(grams[copies].view(np.int64)), pa.array(two.view(np.int32)), ids.take(pa.array(rows + chunk.first)), pa.array(places)]
                yield pa.RecordBatch.from_arrays(cols, names=["p1", "p2", "doc_id", "at"])

    return textvec.lean(run)


def _sources(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Offsets, tags, source documents and source places of a column of probes; null is an empty list."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    fields = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for i in range(3)]
    return np.concatenate([[0], np.cumsum(lengths)]), *fields


def _factors(places: np.ndarray, docs: np.ndarray, sources: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, source document, source start) of one row's factors from its probes, in order of their places."""
    heads = np.ones(len(places), dtype=bool)
    heads[1:] = (np.diff(docs) != 0) | (np.diff(sources - places) != 0) | (np.diff(places) > window)
    first = np.flatnonzero(heads)
    stops = places[np.append(first[1:], len(places)) - 1] + window
    starts = np.maximum(places[first], np.append(0, stops[:-1]))
    return starts, stops - starts, docs[first], sources[first] + starts - places[first]


def _factor_rows(window: int, keep: list[str]):
    """Factors, digests and what is left of each row, with its columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = textvec.column(batch, "doc_id")
            probes = _sources(textvec.column(batch, "probes"))
            for chunk in textvec.chunks(_texts(batch)):
                out = _cut(chunk, probes, window)
                kept = [textvec.column(batch, f"keep_{i}").slice(chunk.first, chunk.rows) for i in range(len(keep))]
                names = ["doc_id", *(f"keep_{i}" for i in range(len(keep))), "n_words", "n_removed", "kept_sha256", "kept_text", "spans", "factors"]
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first, chunk.rows), *kept, *out], names=names)

    return textvec.lean(run)


def _cut(chunk: textvec.Chunk, probes: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], window: int) -> list[pa.Array]:
    """Factors of each row from its probes, and what is left without them."""
    offsets, tags, source_docs, source_places = probes
    grams = chunk.grams(window)
    lens = np.diff(chunk.bounds)
    raw = chunk.data.tobytes()
    removed, texts, digests, spans = np.zeros(chunk.rows, dtype=np.int64), [], [], []
    counts, parts = np.zeros(chunk.rows, dtype=np.int64), []
    for r in range(chunk.rows):
        a, b = int(chunk.bounds[r]), int(chunk.bounds[r + 1])
        words = raw[chunk.start[a] : chunk.end[b - 1]].split() if b > a else []
        found, left = [], raw[chunk.offsets[r] : chunk.offsets[r + 1]]
        lo, hi = offsets[chunk.first + r], offsets[chunk.first + r + 1]
        # Rows that share a doc_id share its probes: those of other texts go, and of equal ones all but one.
        mine, pick = np.unique(tags[lo:hi], return_index=True)
        places = (mine.view(np.uint64) >> np.uint64(32)).astype(np.int64)
        fits = places <= b - a - window
        fits[fits] = mine[fits] == _tag(places[fits], grams[a + places[fits]])
        if fits.any():
            places, pick = places[fits], pick[fits] + lo
            made = _factors(places, source_docs[pick], source_places[pick], window)
            parts.append(made)
            counts[r] = len(made[0])
            cover = np.zeros(b - a + 1, dtype=np.int32)
            cover[made[0]] += 1
            cover[made[0] + made[1]] -= 1
            mask = np.cumsum(cover[:-1]) > 0
            removed[r] = int(mask.sum())
            words = list(compress(words, (~mask).tolist()))
            edges = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
            found = [{"start": int(x), "length": int(y - x)} for x, y in zip(edges[::2], edges[1::2], strict=True)]
            # A span goes with the space behind it.
            stops = [int(chunk.offsets[r]), *(int(chunk.start[a + e]) if a + e < b else int(chunk.offsets[r + 1]) for e in edges), int(chunk.offsets[r + 1])]
            left = b"".join(raw[x:y] for x, y in zip(stops[::2], stops[1::2], strict=True))
        texts.append(left)
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        spans.append(found)
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    starts, sizes, docs, sources = (np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (zip(*parts, strict=True) if parts else [[]] * 4))
    fields = [pa.array(starts.astype(np.int32)), pa.array(sizes.astype(np.int32)), pa.array(docs, pa.int64(), mask=docs == LAST), pa.array(sources.astype(np.int32))]
    factors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "source_doc", "source_start"]))
    return [pa.array(lens.astype(np.int64)), pa.array(removed), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(spans, span), factors]


def _with(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """``rows`` with the list of their document, if it has one."""
    return rows.join(lists.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id"), "left").drop("_id")


def parse(docs: DataFrame, window: int = WINDOW, seed: int = SEED, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, spans, factors) of each row of ``docs`` (doc_id, text; others are ignored).

    ``factors`` are (start, length, source_doc, source_start) in words, ``spans``
    the stretches that they cover as (start, length); ``kept_text`` is the text
    without them, and the digest is of its words joined by one space. The columns
    ``keep`` of ``docs`` follow doc_id as ``keep_0`` and so on: no name clashes.
    Null and empty texts have no words, and no text shorter than a window loses
    any; very long texts are parsed whole. Where rows repeat a doc_id, equal
    windows at equal places are one window, so exact repeats keep what the first
    keeps, and of different places the least is the earliest; a source is then in
    one of the rows of its document. Rows with a null doc_id count as one document
    after all others, and a null source_doc is that one. Empty tables give no rows.
    """
    if not 1 <= seed <= window:
        raise ValueError("a seed has 1 to window words")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text", *[F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)])
    kept = "".join(f"keep_{i} {docs.schema[c].dataType.simpleString()}, " for i, c in enumerate(keep))
    anchors = texts.select("doc_id", "text").mapInArrow(_anchor_rows(window, seed), "anchor long, doc_id long")
    counted = anchors.groupBy("anchor").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    singles = counted.where("n = 1").groupBy("doc_id").agg(F.collect_list("anchor").alias("singles"))
    packed_schema = ", ".join(f"`{f.name}` {'binary' if f.name == 'text' else f.dataType.simpleString()}" for f in texts.schema)
    packed = texts.mapInArrow(textvec.lean(_packed_rows), packed_schema)
    known = _with(packed, singles)
    indexed = known.mapInArrow(_window_rows(window, seed), "w1 long, w2 int, doc_id long, place int")
    if not texts.groupBy("doc_id").count().where("count > 1").isEmpty():
        # Rows that share a doc_id may hold a window at several places: its least one counts.
        indexed = indexed.groupBy("w1", "w2", "doc_id").agg(F.min("place").alias("place"))
    # All that reads the index reads the same columns and rows of it, so that it is exchanged once: the count stays for the filter,
    # and joins would have the optimizer add the test on nulls for some readers only.
    first = indexed.where("w1 is not null and w2 is not null").groupBy("w1", "w2").agg(F.min_by("place", "doc_id").alias("place"), F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).where("n > 0")
    tag = lambda place, w1: F.shiftleft(F.col(place).cast("long"), 32).bitwiseOR(F.col(w1).bitwiseAND(F.lit(0xFFFFFFFF)))
    firsts = first.select("doc_id", tag("place", "w1").alias("tag")).groupBy("doc_id").agg(F.collect_list("tag").alias("firsts"))
    probes = _with(known, firsts).mapInArrow(_probe_rows(window, seed), "p1 long, p2 int, doc_id long, at int")
    hot = first.where(F.col("n") > HOT_LEAST).orderBy(F.desc("n"), "w1", "w2").limit(HOT_SHARE)
    hot = hot.select(F.col("w1").alias("h1"), F.col("w2").alias("h2"), F.col("doc_id").alias("hot_doc"), F.col("place").alias("hot_place"))
    met = probes.join(F.broadcast(hot), (F.col("p1") == F.col("h1")) & (F.col("p2") == F.col("h2")), "left")
    # A probe with an answer is dealt by its own place.
    met = met.withColumn("_key", F.when(F.col("hot_doc").isNull(), F.col("p1")).otherwise(F.xxhash64("doc_id", "at")))
    index = first.select("w1", "w2", F.col("doc_id").alias("first_doc"), F.col("place").alias("first_place"))
    answered = met.join(index, (F.col("_key") == F.col("w1")) & (F.col("p2") == F.col("w2")), "left")
    source = F.struct(tag("at", "p1").alias("tag"), F.coalesce("hot_doc", "first_doc").alias("doc"), F.coalesce("hot_place", "first_place").alias("place"))
    sources = answered.groupBy("doc_id").agg(F.collect_list(source).alias("probes"))
    factor = "array<struct<start:int,length:int,source_doc:bigint,source_start:int>>"
    out = _with(packed, sources).mapInArrow(_factor_rows(window, list(keep)), f"doc_id long, {kept}n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:int,length:int>>, factors {factor}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


def op4_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


ORACLE_SQL = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM docs)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS n FROM grams) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM late, range({WINDOW}) t(k)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM docs),
kept AS (SELECT doc_id, count(g.i) AS n_removed, string_agg(word, ' ' ORDER BY w.i) FILTER (WHERE g.i IS NULL) AS text FROM words w LEFT JOIN gone g USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
