"""Mixing sources to target weights by Pfair scheduling.

A stream of slots takes one block of rows each. A source with target weight w
must have its k-th block (from 1) in the slots [floor((k-1)/w), ceil(k/w)): not
before its release, not after its deadline. Weights are quotas of a period of
slots that sum to the period, so earliest deadline first meets every window, and
a source is never a whole block off its share of any prefix while it has rows.
The schedule repeats with the period; only that bounded table is computed ahead.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treequill.llm.common import number_within, table

#: Slots of a period; a weight is rounded to a multiple of 1 / PERIOD (largest remainder, at least one slot).
PERIOD = 1000
#: Rows of a block.
BLOCK_ROWS = 16
#: The lane of rows whose source is null or has no target of its own.
OTHER = "(other)"
#: Targets of the production mix: the crawl that dominates the table is held to a fifth, every other source gets an equal share.
TARGETS = {"src0": 5.0, **{f"src{i}": 1.0 for i in range(1, 20)}, OTHER: 1.0}


def quotas(targets: Mapping[str, float], period: int = PERIOD) -> dict[str, int]:
    """Slots of each lane in a period, by largest remainder; they sum to the period."""
    lanes = {k: float(w) for k, w in targets.items() if w > 0}
    if not lanes:
        raise ValueError("no source has a positive target weight")
    period = max(period, len(lanes))
    total = sum(lanes.values())
    exact = {k: w / total * period for k, w in lanes.items()}
    out = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(lanes, key=lambda k: (out[k] - exact[k], k))
    short = period - sum(out.values())
    for k in order[: max(0, short)]:
        out[k] += 1
    while sum(out.values()) > period:
        k = max((k for k in out if out[k] > 1), key=lambda k: (out[k] - exact[k], k))
        out[k] -= 1
    return out


def schedule(quota: Mapping[str, int]) -> list[tuple[str, int, int, int, int]]:
    """(lane, block, release, deadline, slot) of one period, earliest deadline first among the released blocks."""
    period = sum(quota.values())
    release = lambda n, j: j * period // n
    deadline = lambda n, j: -(-(j + 1) * period // n)
    waiting = [(0, lane, 0) for lane in sorted(quota)]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, lane, j = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline(quota[lane], j), lane, j))
        due, lane, j = heapq.heappop(ready)
        out.append((lane, j, release(quota[lane], j), due, slot))
        if j + 1 < quota[lane]:
            heapq.heappush(waiting, (max(slot + 1, release(quota[lane], j + 1)), lane, j + 1))
    return out


def mix(docs: DataFrame, targets: Mapping[str, float] = TARGETS, period: int = PERIOD, block_rows: int = BLOCK_ROWS, keep: Sequence[str] = ()) -> DataFrame:
    """Every row of ``docs`` (doc_id, source) with its place in the mixed stream, and the columns ``keep`` after it.

    Rows of a source stand in order of the hash of doc_id and are cut into blocks
    of ``block_rows``. A source that runs out leaves its slots empty; no row is
    dropped or repeated. Sources without a target (null ones too) share the lane
    OTHER; with no target for it their rows come after all others, slot null.
    Repeated rows and ties get places of their own. Empty tables give no rows.
    The stream is the order of (slot, block_row).
    """
    spark = docs.sparkSession
    quota = quotas(targets, period)
    length = sum(quota.values())
    plan = spark.createDataFrame(schedule(quota), "plan_lane string, plan_block int, plan_release long, plan_deadline long, plan_slot long")
    rest = F.lit(OTHER)
    known = [k for k in targets if k != OTHER]
    lane = F.when(F.col("source").isin(known), F.col("source")).otherwise(rest) if known else rest
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.select("doc_id", "source", lane.alias("lane"), digest.alias("_digest"), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)])
    ranked = number_within(rows, "lane", F.substring("_digest", 1, 3), [F.col("_digest"), F.col("doc_id"), F.col("source")], "_rank")
    sizes = F.create_map(*[F.lit(x) for kv in quota.items() for x in kv])
    blocks = ranked.withColumns({"block": F.floor(F.col("_rank") / block_rows), "block_row": (F.col("_rank") % block_rows).cast("int"), "_quota": sizes[F.col("lane")].cast("long")})
    blocks = blocks.withColumns({"_j": (F.col("block") % F.col("_quota")).cast("int"), "_shift": F.floor(F.col("block") / F.col("_quota")) * length})
    # The plan has one row for each slot of a period: bounded by the parameter, whatever the table's size.
    placed = blocks.join(F.broadcast(plan), (F.col("lane") == F.col("plan_lane")) & (F.col("_j") == F.col("plan_block")), "left")
    at = lambda c: (F.col("_shift") + F.col(c)).cast("long")
    return placed.select(
        "doc_id", "source", "lane", "block", "block_row",
        at("plan_release").alias("release"), at("plan_deadline").alias("deadline"), at("plan_slot").alias("slot"),
        *[F.col(f"_keep_{i}").alias(c) for i, c in enumerate(keep)],
    )


def mix_rows(docs: DataFrame, targets: Mapping[str, float] = TARGETS, period: int = PERIOD, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows of ``docs`` themselves in mixed order: range-partitioned and sorted by the stream, so files hold consecutive stretches of it.

    All rows and columns are kept. Rows that repeat a doc_id share its first
    place, null doc_ids likewise; rows without a slot come last.
    """
    places = mix(docs.select("doc_id", "source"), targets, period, block_rows).select(F.col("doc_id").alias("_id"), "slot", "block_row")
    places = places.groupBy("_id").agg(F.min("slot").alias("_slot"), F.min("block_row").alias("_row"))
    # The columns of ``docs`` travel as one struct, so none clashes with a place's.
    whole = docs.select(F.struct("*").alias("_doc"))
    joined = whole.join(places, F.col("_doc.doc_id").eqNullSafe(F.col("_id")), "left")
    key = [F.coalesce("_slot", F.lit(2**62)), F.col("_row")]
    return joined.repartitionByRange(*key).sortWithinPartitions(*key).select("_doc.*")


def op5_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    quota = quotas(TARGETS, PERIOD)
    length = sum(quota.values())
    values = ", ".join(f"('{lane}', {j}, {r}, {d}, {s}, {quota[lane]})" for lane, j, r, d, s in schedule(quota))
    known = ", ".join(f"'{k}'" for k in TARGETS if k != OTHER)
    return f"""
WITH plan(lane, j, release, deadline, slot, quota) AS (VALUES {values}),
rows AS (SELECT doc_id, source, CASE WHEN source IN ({known}) THEN source ELSE '{OTHER}' END AS lane FROM documents),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, source) - 1 AS k FROM rows),
blocks AS (SELECT *, k // {BLOCK_ROWS} AS block, (k % {BLOCK_ROWS})::INT AS block_row FROM ranked)
SELECT doc_id, source, b.lane AS lane, block, block_row,
       (block // quota) * {length} + release AS release, (block // quota) * {length} + deadline AS deadline, (block // quota) * {length} + slot AS slot
FROM blocks b JOIN plan p ON p.lane = b.lane AND p.j = b.block % p.quota
"""


ORACLE_SQL = _oracle()
