"""Session helpers: reading tables, cutting lineage, bounded broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class NoSharedFolder(RuntimeError):
    """A cluster session names no folder that all executors share."""


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Where the session names none, a temporary folder is set, but only if the
    master is local[...]: on a cluster each executor would write to its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise NoSharedFolder("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanmill-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """Tables written once to the shared checkpoint folder and read again.

    A written table cuts the lineage and survives lost executors. `drop`
    removes tables an iterative operator no longer needs.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{checkpoint_root(spark)}/spanmill/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        self.n += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def close(self) -> None:
        """Deletes all tables of this operator; its results can't be read after that."""
        self._delete(self.base)

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            self._delete(df._scratch_path)

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def is_empty(df: DataFrame) -> bool:
    return len(df.head(1)) == 0


class TooLargeToBroadcast(ValueError):
    """A table meant for every executor is larger than its stated bound."""
