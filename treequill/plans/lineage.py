"""What plans need of the cluster: this package on the executors, and cut lineage, so that a lost executor costs no recomputation of long plans."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: they may lack it."""
    sc = spark.sparkContext
    if getattr(sc, "_treequill_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(), "treequill.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        file = os.path.join(folder, name)
                        out.write(file, os.path.relpath(file, os.path.dirname(root)))
        sc.addPyFile(path)
    sc._treequill_shipped = True  # type: ignore[attr-defined]


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores at least. For a few files of rows that cost more to parse than to exchange; not for plans with exchanges, which this would run."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def cut(df: DataFrame) -> DataFrame:
    """``df`` materialised in the shared folder of spark.checkpoint.dir, or one below the warehouse where that is unset."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"  # type: ignore[union-attr]
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)
