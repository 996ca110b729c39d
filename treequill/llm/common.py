"""Helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from treequill.plans.lineage import cut, ship

__all__ = ["SPACE", "checkpoint_root", "cut", "join_counted", "number_within", "ship", "table"]

#: The word separators of all contracts, as a Java and RE2 character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for written tables: the cluster's own, or one below the warehouse where it is unset."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"  # type: ignore[union-attr]


#: A key is hot with more than HOT_LEAST rows and more than one HOT_SHARE-th of all rows, so fewer than HOT_SHARE keys are hot.
HOT_SHARE, HOT_LEAST = 1000, 256


def join_counted(rows: DataFrame, key: str, counted: DataFrame, count: str, total: int, largest: int) -> DataFrame:
    """``rows`` joined to ``counted``, which has one row for each key of ``rows`` (a column of the same name) that may go on.

    ``count`` is how many rows have the key, at most; they sum to ``total`` and the
    largest is ``largest``, both at most. The rows of ``counted`` of hot keys are
    broadcast, being fewer than HOT_SHARE, and hot rows stay where they are; the
    others meet by key, so no task gets more than the hot share of the rows for one
    key. A null key meets nothing.
    """
    other = counted.withColumnRenamed(key, "_key")
    least = max(HOT_LEAST, total // HOT_SHARE)
    if largest <= least:
        return rows.join(other, F.col(key) == F.col("_key")).drop("_key")
    hot = other.where(F.col(count) > least)
    warm = rows.join(F.broadcast(hot), F.col(key) == F.col("_key")).drop("_key")
    rest = rows.join(F.broadcast(hot.select("_key")), F.col(key) == F.col("_key"), "left_anti")
    return warm.union(rest.join(other.where(F.col(count) <= least), F.col(key) == F.col("_key")).drop("_key"))


def number_within(df: DataFrame, lane: str, bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Gapless numbers from 0 in each ``lane``, in order of (bucket, order).

    A window over a whole lane would put a hot lane in one task. Here each
    (lane, bucket) is numbered on its own and shifted by the rows of the
    lane's earlier buckets. The shifts join on the key that the numbering is
    dealt by, so they cost no exchange of the rows beyond its own. Buckets must
    sort as the order does.
    """
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(lane, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(lane).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        F.col(lane).alias("_lane"),
        F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"),
    )
    joined = df.join(shifts, (F.col(lane) == F.col("_lane")) & (F.col("_bucket") == F.col("_b")))
    rank = F.row_number().over(Window.partitionBy(lane, "_bucket").orderBy(*order))
    return joined.withColumn(name, (F.col("_shift") + rank - 1).cast("long")).drop("_lane", "_b", "_shift", "_bucket")
