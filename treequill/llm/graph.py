"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treequill.llm.common import cut, join_counted


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the component's least node.

    Alternates large-star and small-star steps, which hang each node under the
    least node it can see, until a whole round changes nothing. A step is one
    aggregation that combines map-side, then a join on the same key; the rows of
    hubs with a large share of all edges stay where they are (see
    ``join_counted``). Rounds grow with the logarithm of the longest chain. Edges
    are cut to the shared checkpoint folder each round.
    """
    edges = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    def state(some: DataFrame) -> tuple[int, int, int]:
        """Edges, edges of the largest hub, and a checksum: a round that changes none of them has changed nothing."""
        hubs = some.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h"))
        return tuple(hubs.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.bit_xor("h")).first())

    now = state(edges)
    while now[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
        large = join_counted(both.where("v > u"), "u", least, "_n", *now[:2]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        below = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "_u")
        small = large.join(below, F.col("u") == F.col("_u"))
        after = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges, before = cut(after.select("e.u", "e.v").where("u <> v").distinct()), now
        now = state(edges)
        if now == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
