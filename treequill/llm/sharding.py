"""Sharding by a hierarchical weighted hash tree.

A cluster is a tree of regions, racks and shards, each shard with a weight; an
inner node weighs the sum of its shards. A row descends the tree: at each node
every child draws ``-ln(u) / weight`` with u a hash of (row key, child), and the
smallest draw wins. Draws of unchanged children stay as they are, so a change of
weights moves rows only into or out of the subtrees whose weights changed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm.common import number_within, table

#: Regions of racks of shard weights; shards are numbered from 0 in this order.
Tree = Sequence[Sequence[Sequence[float]]]

#: Two regions of two racks of two equal shards.
EIGHT: Tree = (((1.0, 1.0), (1.0, 1.0)), ((1.0, 1.0), (1.0, 1.0)))
#: Hash buckets that a shard's slots are numbered in; each (shard, bucket) is one window group.
SLOT_BUCKETS = 1024


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """``tree`` with one more shard, in a region of its own: no present subtree changes weight, so rows move only into it."""
    return (*tree, ((weight,),))


def _draw(key: Column, path: str, weight: float) -> Column:
    """An exponential draw of rate ``weight`` from 52 bits of the hash of (key, path)."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 12)
    return -F.log((bits.cast("double") + 0.5) / float(2**52)) / F.lit(float(weight))


def _winner(key: Column, children: Sequence[tuple[str, float, Column]]) -> Column:
    """The value of the child with the least draw; children of weight 0 get nothing."""
    alive = [(p, w, v) for p, w, v in children if w > 0]
    if not alive:
        return F.lit(None).cast("int")
    if len(alive) == 1:
        return alive[0][2]
    return F.array_min(F.array(*[F.struct(_draw(key, p, w).alias("d"), v.alias("v")) for p, w, v in alive]))["v"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that ``key`` falls into; a null key is hashed like any other value."""
    total = lambda node: sum(map(total, node)) if isinstance(node, Sequence) else float(node)
    shard, regions = 0, []
    for r, region in enumerate(tree):
        racks = []
        for k, rack in enumerate(region):
            leaves = []
            for s, weight in enumerate(rack):
                leaves.append((f"{r}/{k}/{s}", float(weight), F.lit(shard)))
                shard += 1
            racks.append((f"{r}/{k}", total(rack), leaves))
        regions.append((f"{r}", total(region), racks))
    # Each level is decided before the next one draws: CASE evaluates only the chosen branch.
    region_no = _winner(key, [(p, w, F.lit(i)) for i, (p, w, _) in enumerate(regions)])
    out = None
    for i, (_, weight, racks) in enumerate(regions):
        if weight <= 0:
            continue
        rack_no = _winner(key, [(p, w, F.lit(j)) for j, (p, w, _) in enumerate(racks)])
        inner = None
        for j, (_, w, leaves) in enumerate(racks):
            if w > 0:
                leaf = _winner(key, leaves)
                inner = F.when(rack_no == j, leaf) if inner is None else inner.when(rack_no == j, leaf)
        out = F.when(region_no == i, inner) if out is None else out.when(region_no == i, inner)
    return out.cast("int")


def assign(docs: DataFrame, tree: Tree = EIGHT, grown: Tree | None = None, slot_buckets: int = SLOT_BUCKETS) -> DataFrame:
    """Shard, slot and next shard of every row of ``docs`` (doc_id, text; other columns are ignored).

    doc_id and the tree decide; texts do not matter, however long. Null texts have size 1 and
    the checksum of the empty text. Null doc_ids share one hash and so one shard.
    Rows that repeat a doc_id go to the same shard and get slots of their own. Empty tables give no rows.
    """
    grown = grow(tree) if grown is None else grown
    key, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(key, tree).alias("shard"),
        shard_of(key, grown).alias("grown_shard"),
    )
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", F.lit("slot")), F.lit(slot_buckets)).cast("int")
    out = number_within(placed, "shard", bucket, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op8_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
