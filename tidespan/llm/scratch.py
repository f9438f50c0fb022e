"""Intermediate tables in the folder that every executor shares.

The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the master is local (tests, a laptop) is a temporary folder made.
Tables are ordinary Parquet, so a lost executor costs a re-read and no recomputation of what is above the table.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir: the executors of a cluster share no temporary folder")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidespan-")
    return _OWN[app]


class Scratch:
    """Tables of one operator call. ``drop`` removes some of them, ``clear`` all."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidespan/{owner}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return it read back, its lineage cut."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidespan_path = path
        return out

    def _delete(self, path: str) -> None:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that are not needed again, and let executors delete the shuffle files that made them.

        Spark deletes shuffle files once the driver has collected the plans that read them. A driver with little to do may not collect
        for half an hour, while every finished step's files stay on the executors' disks.
        """
        for df in tables:
            if path := getattr(df, "_tidespan_path", None):
                self._delete(path)
        gc.collect()
        self.spark._jvm.System.gc()

    def clear(self) -> None:
        self._delete(self.root)


def aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns that begin with an underscore renamed, so that none meets a helper column of an operator; and how to name them back."""
    taken, back = set(docs.columns), {}
    for c in docs.columns:
        if c.startswith("_"):
            free = next(n for i in range(len(taken) + 1) if (n := f"aside_{len(back)}_{i}") not in taken)
            taken.add(free)
            back[free] = c
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def slices(batches, rows: int = 256):
    """Arrow batches cut into short ones, so that what Python makes of a batch stays small."""
    for batch in batches:
        if not batch.num_rows:
            yield batch
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
