"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Only a local session, as in tests, may name none and gets a folder of our own."""
    context = spark.sparkContext._jsc.sc()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if context.getCheckpointDir().isDefined():
        return named or context.getCheckpointDir().get()
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = named or tempfile.mkdtemp(prefix="spectraloom-")
    spark.sparkContext.setCheckpointDir(found)
    return found


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/spectraloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, block: int | None = None) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet in the shared folder and read it back.

    A task holds a whole row group that it reads and one that it writes; ``block`` bounds their bytes where rows are wide.
    """
    path = scratch(df.sparkSession, name)
    (df.write.option("parquet.block.size", block) if block else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables written for one computation, to be dropped together once its result is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(scratch(self.spark, name))
        df.write.parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self) -> None:
        while self.paths:
            drop_path(self.spark, self.paths.pop())


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in a fixed number of tasks, a few for each core.

    Left to itself, Spark joins tasks by their bytes, and where each row is work for Python, few bytes are many seconds.
    """
    return df.repartition(max(32, 4 * df.sparkSession.sparkContext.defaultParallelism), *keys)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Spark's file system layer."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
