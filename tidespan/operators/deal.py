"""How rows are dealt to tasks whose work outweighs their bytes."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame


def by_key(rows: DataFrame, *key: str) -> DataFrame:
    """The rows dealt by key over all cores. Spark merges the small partitions of a shuffle of its own by their bytes, which leaves a battery of
    draws over a few megabytes to two or three tasks; a number asked for is kept."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *key)


def once(rows: DataFrame) -> DataFrame:
    """Rows that cost much more than their bytes and are read twice: computed once, kept in the folder of spark.checkpoint.dir, or without one on
    the executors' disks until nothing refers to them."""
    spark = rows.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None):
        return rows.checkpoint()
    return rows.localCheckpoint(False, StorageLevel.DISK_ONLY)
