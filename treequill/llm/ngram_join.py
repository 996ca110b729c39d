"""N-gram Jaccard self-join by chosen paths.

Texts become sets of the hashes of their five-word shingles. Equal sets form a
class, which goes on as one. A class carries a signature of least hashes, each a
uniformly sampled shingle of its set; where two sets agree in a coordinate, the
sampled shingle is one that they share.

A run is a tree. The root holds all classes; a node samples coordinates, each of
which sends every class to the child of its shingle there. With a threshold of
0.8 a node samples 1 / 0.8 coordinates on average, so two sets of that
similarity stay together somewhere with a probability that falls only slowly
with depth. Children of one class end. Children of at most ``BUCKET`` classes are
brute-forced on signatures; larger ones are split again, and what the deepest
level still holds together is brute-forced whatever its size. Runs differ by
their seeds; their number follows from the recall wanted in nodes of the first
level, and classes of nodes that are split take part in as many more as the
deepest level needs.

Brute force works in square tiles of bounded size: a node's classes are dealt to
sides, and each pair of sides is a tile. Classes that a tile holds similar by
signature are linked into groups. All pairs of a group are then verified on whole
sets, in tiles again, each pair in exactly one; tiles give sums for each class
and a spanning forest, never lists of pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm import textvec
from treequill.llm.common import cut, join_counted, ship, table
from treequill.llm.graph import components

SHINGLE = 5
THRESHOLD = 0.8
#: Wanted share of the linked pairs.
RECALL = 0.999
#: Coordinates of a signature (a multiple of 8), and how far an estimate from them may fall below the threshold: four standard deviations.
COORDINATES = 48
SLACK = 4.0
#: A run starts with nodes of this depth, has no deeper nodes than the second number, and brute-forces buckets up to the third.
START_DEPTH, MOST_DEPTH, BUCKET = 2, 8, 4096
#: Classes on a side of a tile, of signatures and of whole sets, and the bytes of sets that a side holds on average at most.
SIDE, TILE, TILE_BYTES = 512, 256, 1 << 25
#: What names a tile.
TILE_KEYS = ("of", "low", "high")
#: Rows of a signature tile that are compared with all others at a time.
ROWS = 64


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = START_DEPTH) -> int:
    """Runs until a pair at the threshold has met in a node of ``depth`` with probability ``recall``; a node samples one coordinate at least."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def deep_runs_for(recall: float, threshold: float = THRESHOLD, depth: int = MOST_DEPTH) -> int:
    """Runs until a pair at the threshold has met in a node of ``depth``, by the tree's own chance of a second coordinate."""
    met, second = 1.0, 1 / threshold - 1
    for _ in range(depth):
        stays = threshold * met
        met = (1 - second) * stays + second * (1 - (1 - stays) ** 2)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def _shingles(chunk: textvec.Chunk, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, sorted; a text of fewer than n words is one shingle."""
    grams = chunk.grams(n)
    inside = np.flatnonzero(chunk.inside(n))
    rows, values = chunk.row_of_word()[inside], grams[inside]
    lens = np.diff(chunk.bounds)
    short = np.flatnonzero((lens > 0) & (lens < n))
    if len(short):
        extra = np.array([_few(chunk, int(r)) for r in short], dtype=np.uint64)
        rows, values = np.concatenate([rows, short]), np.concatenate([values, extra])
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (np.diff(rows) != 0) | (values[1:] != values[:-1])
    return rows[new], values[new]


def _few(chunk: textvec.Chunk, row: int) -> np.uint64:
    a, b = int(chunk.bounds[row]), int(chunk.bounds[row + 1])
    return textvec.gram_hashes(chunk.hashes[a:b], b - a, textvec._GRAM_BASE)[0] ^ np.uint64(b - a)


def _seeds(n: int) -> np.ndarray:
    return textvec.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, n)


def _signatures(rows: np.ndarray, values: np.ndarray, count: int, k: int) -> np.ndarray:
    """The k least hashes of each row's shingles as 32-bit numbers; rows without any get zeros."""
    out = np.zeros((count, k), dtype=np.uint32)
    if len(rows) == 0:
        return out
    heads = np.flatnonzero(np.diff(rows, prepend=-1))
    folded = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    mul, add = _seeds(k).astype(np.uint32)
    for j in range(k):
        h = folded * (mul[j] | np.uint32(1)) + add[j]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[rows[heads], j] = np.minimum.reduceat(h, heads)
    return out


def _set_rows(shingle: int, k: int):
    """Set digest, size and signature of each text, beside its doc_id and text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes = textvec.column(batch, "doc_id"), textvec.column(batch, "text_hash")
            for chunk in textvec.chunks(textvec.column(batch, "text")):
                rows, values = _shingles(chunk, shingle)
                signs = _signatures(rows, values, chunk.rows, k)
                bounds = np.searchsorted(rows, np.arange(chunk.rows + 1))
                digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() for a, b in zip(bounds, bounds[1:], strict=False)]
                cols = [*(x.slice(chunk.first, chunk.rows) for x in (ids, hashes)), pa.array(digests, pa.binary()), pa.array(np.diff(bounds).astype(np.int64)), pa.array([s.tobytes() for s in signs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "text_hash", "digest", "n_shingles", "signature"])

    return textvec.lean(run)


def _key(parts: np.ndarray, more: np.ndarray | int) -> np.ndarray:
    return textvec.mix(parts * np.uint64(0xD6E8FEB86659FD93) + np.asarray(more, dtype=np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _children(keys: np.ndarray, signs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(entry, child key) of each entry with node ``keys``: the node samples one coordinate, and a second with probability 1 / threshold - 1."""
    k = signs.shape[1]
    draw = _key(keys, 1)
    places = [(draw % np.uint64(k)).astype(np.int64), (_key(keys, 2) % np.uint64(k)).astype(np.int64)]
    twice = (_key(keys, 3) >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / threshold - 1
    every = np.arange(len(keys))
    entries, out = [], []
    for n, place in enumerate(places):
        pick = every if n == 0 else np.flatnonzero(twice & (places[1] != places[0]))
        shared = signs[pick, place[pick]].astype(np.uint64)
        entries.append(pick)
        out.append(_key(_key(keys[pick], place[pick].astype(np.uint64) + np.uint64(4)), shared))
    return np.concatenate(entries), np.concatenate(out)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), -1)


def _root_rows(runs: range, depth: int, threshold: float):
    """The nodes of ``depth`` that each class falls into, in every one of ``runs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(textvec.column(batch, "signature"))
            for seed in runs:
                at, keys = np.arange(len(signs)), np.full(len(signs), 0x5851F42D4C957F2D * (seed + 1) % (1 << 64), dtype=np.uint64)
                for _ in range(depth):
                    entry, keys = _children(keys, signs[at], threshold)
                    at = at[entry]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), textvec.column(batch, "cls").take(pa.array(at))], names=["node", "cls"])

    return textvec.lean(run)


def _split_rows(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _matrix(textvec.column(batch, "signature"))
            entry, keys = _children(textvec.column(batch, "node").to_numpy().view(np.uint64), signs, threshold)
            at = pa.array(entry)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), textvec.column(batch, "cls").take(at), textvec.column(batch, "signature").take(at)], names=["node", "cls", "signature"])

    return textvec.lean(run)


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one value of ``keys`` each, from a stream that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = [textvec.column(batch, k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            here = tuple(x[a] for x in columns)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _forest(similar: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric boolean matrix, as edges from where a node was met."""
    left = np.ones(len(similar), dtype=bool)
    out: list[tuple[int, int]] = []
    for root in np.flatnonzero(similar.any(axis=1)).tolist():
        if not left[root]:
            continue
        left[root] = False
        open_ = [root]
        for i in open_:
            met = np.flatnonzero(similar[i] & left).tolist()
            left[met] = False
            out += [(i, j) for j in met]
            open_ += met
    return out


def _alike(signs: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a matrix of signatures agree in ``least`` coordinates or more, by a byte of each; not with themselves."""
    n, k = signs.shape
    if n <= 16:
        same = (signs[:, None, :] == signs[None, :, :]).sum(axis=2) >= least
    else:
        places = np.ascontiguousarray(signs.astype(np.uint8).T)
        same = np.empty((n, n), dtype=bool)
        for low in range(0, n, ROWS):
            count = np.zeros((min(ROWS, n - low), n), dtype=np.uint8)
            for place in places:
                count += place[low : low + ROWS, None] == place[None, :]
            same[low : low + ROWS] = count >= least
    np.fill_diagonal(same, False)
    return same


def _edge_batch(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


def _bucket_rows(threshold: float, slack: float):
    """Edges of a spanning forest of the classes in each tile that look similar by signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges: list[tuple[int, int]] = []
        for group in _groups(batches, TILE_KEYS):
            if group.num_rows < 2:
                continue
            ids, signs = group["cls"].to_numpy(), _matrix(group["signature"].combine_chunks())
            k = signs.shape[1]
            same = _alike(signs, k * threshold - slack * math.sqrt(k * threshold * (1 - threshold)))
            edges += [(int(ids[i]), int(ids[j])) for i, j in _forest(same)]
            if len(edges) > 10_000:
                yield _edge_batch(edges)
                edges = []
        yield _edge_batch(edges)

    return textvec.lean(run)


def _shingle_rows(shingle: int):
    """The whole shingle set of each class, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(textvec.column(batch, "text")):
                rows, values = _shingles(chunk, shingle)
                bounds = np.searchsorted(rows, np.arange(chunk.rows + 1))
                sets = pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())
                kept = [textvec.column(batch, c).slice(chunk.first, chunk.rows) for c in ("cls", "root", "copies", "side", "sides")]
                yield pa.RecordBatch.from_arrays([*kept, sets], names=["cls", "root", "copies", "side", "sides", "set"])

    return textvec.lean(run)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, from products of incidence matrices."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    tokens = np.concatenate(sets)
    if n == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    counts = np.diff(np.append(heads, len(tokens)))
    shared = np.repeat(counts > 1, counts)
    number = np.repeat(np.cumsum(counts > 1) - 1, counts)[shared]
    owner = owner[shared]
    out = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        part = slice(np.searchsorted(number, low), np.searchsorted(number, low + 4096))
        block = np.zeros((n, 4096), dtype=np.float32)
        block[owner[part], number[part] - low] = 1
        out += block @ block.T
    return out


def _tile_rows(threshold: float):
    """For each tile: what each class links to there, and a spanning forest of the links as (a, b)."""

    part, whole = Fraction(threshold).limit_denominator(10**6).as_integer_ratio()

    def batch(links: list[tuple[int, int, int | None]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(3)], names=["cls", "links", "other"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int | None]] = []
        for group in _groups(batches, TILE_KEYS):
            if group.num_rows < 2:
                continue
            ids, side, copies = group["cls"].to_pylist(), group["side"].to_numpy(), group["copies"].to_numpy()
            low, high = group["low"][0].as_py(), group["high"][0].as_py()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in group["set"].to_pylist()]
            sizes = np.array([len(x) for x in sets], dtype=np.int64)
            both = _overlaps(sets).astype(np.int64)
            # |A n B| >= t |A u B| in whole numbers, for t = part / whole.
            similar = both * whole >= part * (sizes[:, None] + sizes[None, :] - both)
            np.fill_diagonal(similar, False)
            if low != high:
                similar &= side[:, None] != side[None, :]
            sums = similar @ copies
            out += [(ids[i], int(sums[i]), None) for i in np.flatnonzero(sums).tolist()]
            out += [(ids[i], 0, ids[j]) for i, j in _forest(similar)]
            if len(out) > 10_000:
                yield batch(out)
                out = []
        yield batch(out)

    return textvec.lean(run)


def _tiled(rows: DataFrame, key: str, sides: Column, columns: Sequence[str], function, schema: str) -> DataFrame:
    """``function`` over the square tiles of the rows of each ``key``, one at a time.

    Rows are dealt to ``sides`` by their class. Tile (low, high) holds the sides low
    and high, so a row is in as many tiles as its key has sides, and every two rows
    of a key are in one tile at least, in just one if their sides differ.
    """
    placed = rows.withColumn("sides", sides.cast("long"))
    if "side" not in rows.columns:
        placed = placed.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("sides")))
    one = placed.where("sides <= 1").select(F.col(key).alias("of"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"), "side", *columns)
    spread = placed.where("sides > 1").withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)))
    many = spread.select(F.col(key).alias("of"), F.least("side", "_other").alias("low"), F.greatest("side", "_other").alias("high"), "side", *columns)
    return one.union(many).repartition(*TILE_KEYS).sortWithinPartitions(*TILE_KEYS, "cls").mapInArrow(function, schema)


def _classified(texts: DataFrame, threshold: float, shingle: int, recall: float, coordinates: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``texts`` (doc_id, text, text_hash) as (doc_id, text_hash, digest), and their classes.

    Classes have digest, the least row's doc_id and text_hash (rep, rep_hash),
    copies, links, and of the class that stands for the group its rep (class_id)
    and whether it is this one (chosen).
    """
    schema = "doc_id long, text_hash long, digest binary, n_shingles long, signature binary"
    sets = cut(texts.where("doc_id is not null").mapInArrow(_set_rows(shingle, coordinates), schema))
    least = F.min(F.struct("doc_id", "text_hash")).alias("least")
    equal = sets.groupBy("digest").agg(least, F.count(F.lit(1)).alias("copies"), F.min("n_shingles").alias("n_shingles"), F.min("signature").alias("signature"))
    # The numbers hold because the classes are written.
    classes = cut(equal.select(F.monotonically_increasing_id().alias("cls"), "digest", F.col("least.doc_id").alias("rep"), F.col("least.text_hash").alias("rep_hash"), "copies", "n_shingles", "signature"))
    live = classes.where("n_shingles > 0").select("cls", "signature")
    signs = live.withColumnRenamed("cls", "_cls")

    def shared(found: DataFrame) -> DataFrame:
        """The rows of ``found`` in nodes that two classes share, with the number of those classes."""
        counts = cut(found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        total, largest = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
        return join_counted(found, "node", counts, "n", total, largest)

    def rooted(some: DataFrame, runs: range) -> DataFrame:
        found = shared(cut(some.mapInArrow(_root_rows(runs, START_DEPTH, threshold), "node long, cls long")))
        return cut(found.join(signs, F.col("cls") == F.col("_cls")).select("node", "cls", "signature", "n"))

    first = runs_for(recall, threshold)
    nodes = rooted(live, range(first))
    more = range(first, deep_runs_for(recall, threshold, MOST_DEPTH))
    crowded = nodes.where(F.col("n") > BUCKET)
    if more and not crowded.isEmpty():
        nodes = nodes.union(rooted(crowded.select("cls", "signature").dropDuplicates(["cls"]), more))
    buckets = []
    for depth in range(START_DEPTH, MOST_DEPTH + 1):
        # The deepest nodes are brute-forced at any size.
        large = nodes.where(F.col("n") > BUCKET) if depth < MOST_DEPTH else None
        buckets.append(nodes if large is None else nodes.where(F.col("n") <= BUCKET))
        if large is None or large.isEmpty():
            break
        split = cut(large.select("node", "cls", "signature").mapInArrow(_split_rows(threshold), "node long, cls long, signature binary"))
        nodes = cut(shared(split))
    edges = None
    for bucket in buckets:
        found = _tiled(bucket, "node", F.ceil(F.col("n") / SIDE), ["cls", "signature"], _bucket_rows(threshold, SLACK), "a long, b long")
        edges = found if edges is None else edges.union(found)
    members = components(edges).join(classes.select("cls", "rep", "rep_hash", "copies", "n_shingles"), F.col("node") == F.col("cls")).drop("node")
    members = cut(members)
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("tokens"))
    # Verified groups lie within these, so the numbers hold for both.
    total, largest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    sides = F.greatest(F.ceil(F.col("n") / tile), F.ceil(F.col("tokens") * 8 / TILE_BYTES)).cast("long")
    placed = join_counted(members, "root", sizes.select("root", "n", sides.alias("sides")), "n", total, largest)
    links, forest = _verify(texts, placed, threshold, shingle)
    linked = components(forest).withColumnRenamed("node", "cls").join(classes.select(F.col("cls").alias("_cls"), "rep"), F.col("cls") == F.col("_cls")).drop("_cls")
    linked = cut(linked)
    tops = linked.groupBy("root").agg(F.min(F.struct("rep", "cls")).alias("top"), F.count(F.lit(1)).alias("n"))
    tops = join_counted(linked.select("cls", "root"), "root", tops, "n", total, largest).select(F.col("cls").alias("_cls"), "top")
    named = classes.join(tops, F.col("cls") == F.col("_cls"), "left").join(links, F.col("cls") == F.col("_linked"), "left")
    named = named.select(
        "digest", "rep", "rep_hash", "copies", F.coalesce("links", F.lit(0)).alias("links"),
        F.coalesce("top.rep", "rep").alias("class_id"), (F.coalesce("top.cls", "cls") == F.col("cls")).alias("chosen"),
    )
    return sets.select("doc_id", "text_hash", "digest"), cut(named)


def _texts(docs: DataFrame) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))


def join(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, coordinates: int = COORDINATES, tile: int = TILE) -> DataFrame:
    """(doc_id, rep, class_id, n_copies, n_links) of each row of ``docs`` (doc_id, text; others are ignored).

    ``rep`` is the least doc_id of the rows with the same shingle set, ``n_copies``
    how many those are. ``n_links`` counts the other rows whose sets are similar by
    the threshold, equal ones included, and ``class_id`` is the least doc_id that
    links lead to. Texts without words (null ones too) have equal sets, and a text
    of fewer words than a shingle has itself as its only shingle. A text of any
    length is one set, whole. A null doc_id is a row without links, of a class of
    its own: null. Rows that repeat a doc_id are rows of their own, whether their
    sets are equal or not. Empty tables give no rows.
    """
    texts = _texts(docs)
    sets, classes = _classified(texts, threshold, shingle, recall, coordinates, tile)
    named = classes.select("digest", "rep", "class_id", F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))
    rows, most = classes.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.max("copies"), F.lit(0))).first()
    out = join_counted(sets.select("doc_id", "digest"), "digest", named, "n_copies", rows, most).select("doc_id", "rep", "class_id", "n_copies", "n_links")
    lone = texts.where("doc_id is null").selectExpr("doc_id", "doc_id as rep", "doc_id as class_id", "1L as n_copies", "0L as n_links")
    return out.union(lone)


def _verify(texts: DataFrame, placed: DataFrame, threshold: float, shingle: int) -> tuple[DataFrame, DataFrame]:
    """(_linked, links) and the forest (a, b) of the verified links of the classes in ``placed`` (cls, root, rep, rep_hash, copies, sides)."""
    placed = placed.withColumn("side", F.pmod(F.xxhash64("cls"), F.col("sides")))
    whole = texts.join(placed, (F.col("doc_id") == F.col("rep")) & (F.col("text_hash") == F.col("rep_hash"))).select("cls", "root", "copies", "side", "sides", "text")
    # Rows that repeat a doc_id and its text give their class's set more than once.
    sets = whole.mapInArrow(_shingle_rows(shingle), "cls long, root long, copies long, side long, sides long, set binary").dropDuplicates(["cls"])
    found = cut(_tiled(sets, "root", F.col("sides"), ["cls", "copies", "set"], _tile_rows(threshold), "cls long, links long, other long"))
    links = found.groupBy("cls").agg(F.sum("links").alias("links")).select(F.col("cls").alias("_linked"), "links")
    return links, found.where("other is not null").select(F.col("cls").alias("a"), F.col("other").alias("b"))


def representatives(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, recall: float = RECALL, coordinates: int = COORDINATES, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that stand for their group: of each class of linked rows the one with the least doc_id.

    All columns are kept, and so are rows with a null doc_id. Of rows that repeat
    a doc_id and its text one stays; rows that repeat a doc_id with texts that are
    not alike all stay.
    """
    texts = _texts(docs)
    sets, classes = _classified(texts, threshold, shingle, recall, coordinates, tile)
    chosen = classes.where("chosen").select(F.col("rep").alias("_rep"), "rep_hash")
    stands = lambda rows, digest: (rows["doc_id"] == chosen["_rep"]) & (digest == chosen["rep_hash"])
    kept = docs.join(chosen, stands(docs, F.xxhash64(docs["text"])), "left_semi")
    repeats = sets.join(chosen, stands(sets, sets["text_hash"]), "left_semi").groupBy("doc_id", "text_hash").count().where("count > 1")
    if not repeats.isEmpty():
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.union(docs.where("doc_id is null"))


def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_SQL = rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {SHINGLE} THEN [array_to_string(ws, ' ')]
    ELSE [array_to_string(ws[i:i + {SHINGLE - 1}], ' ') FOR i IN range(1, len(ws) - {SHINGLE - 2})] END) AS g FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y, k = p.n AND k = q.n AS equal FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * k >= 4 * (p.n + q.n - k)
    UNION ALL SELECT a.doc_id, b.doc_id, true FROM docs a JOIN docs b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.doc_id <> b.doc_id),
reach(x, y) AS (SELECT doc_id, doc_id FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
classes AS (SELECT x, min(y) AS class_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n_links, min(y) FILTER (WHERE equal) AS twin, count(*) FILTER (WHERE equal) AS twins FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(twin, doc_id)) AS rep, class_id, coalesce(twins, 0) + 1 AS n_copies, coalesce(n_links, 0) AS n_links
FROM docs JOIN classes c ON c.x = doc_id LEFT JOIN degrees d ON d.x = doc_id
"""
