"""Tables in the shared folder: lineage is cut by writing them, and they go when the driver ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder that the cluster names. Where none is set, a temporary one of this machine,
    which only a local session may use: the executors of a cluster would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="lintloom-")
    return f"{base.rstrip('/')}/lintloom/{uuid.uuid4().hex}"


def _fs_path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


class Scratch:
    """Parquet tables in the shared folder, for cutting lineage. What is left goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.n = spark, shared_dir(spark), 0
        fs, path = _fs_path(spark, self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def path(self, name: str) -> str:
        """A place for a table or file of its own."""
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        fs, path = _fs_path(self.spark, df._scratch_path)
        fs.delete(path, True)
