"""Tiles from a stream, with rows that come after their tile was sealed.

Every micro-batch writes the partial cells of its rows to a folder of its own, so a batch that is run again after a failure writes
the same folder again. Nothing goes through Spark's watermark, so nothing is dropped: a tile is sealed once the stream's newest
time is ``late`` past its end, and what comes later is marked and merged like the rest, as a further revision of the tile.
No state is held between batches but one row a batch with its newest time; ``compact`` merges folders as the store grows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.tiles import merge_cells
from spectraloom.sources.shared import drop_path, scratch


class TileStore:
    """Partial cells under ``path``: ``cells/batch=k`` (f, t, …, late) and ``marks/batch=k`` (newest)."""

    def __init__(self, spark: SparkSession, path: str, cells: Callable[[DataFrame], DataFrame], ts: str, length_us: int, late_us: int):
        self.spark, self.path, self.cells, self.ts, self.length, self.late = spark, path, cells, ts, length_us, late_us

    def _read(self, what: str) -> DataFrame | None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}")
        if not where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return None
        return self.spark.read.option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")

    def newest(self, before: int | None = None) -> int | None:
        """The newest time of all batches, or of those before one."""
        marks = self._read("marks")
        if marks is None:
            return None
        return marks.where(F.lit(True) if before is None else F.col("batch") < before).agg(F.max("newest")).first()[0]

    def add(self, batch: DataFrame, number: int) -> None:
        """What a micro-batch adds; the same number again takes the place of what it added before."""
        newest = self.newest(number)
        late = F.lit(False) if newest is None else (F.col("t") + 1) * self.length <= newest - self.late
        self.cells(batch).withColumn("late", late).write.mode("overwrite").parquet(f"{self.path}/cells/batch={number}")
        batch.agg(F.max(self.ts).alias("newest")).write.mode("overwrite").parquet(f"{self.path}/marks/batch={number}")

    def tiles(self) -> DataFrame:
        """Each tile as all rows say, whether it is sealed, its late rows and its revision (batches that came after its seal)."""
        parts, newest = self._read("cells"), self.newest()
        end = (F.col("t") + 1) * self.length
        marks = parts.groupBy("f", "t").agg(F.coalesce(F.sum(F.when(F.col("late"), F.col("n"))), F.lit(0)).alias("n_late"), F.count_if("late").alias("revision"))
        return merge_cells(parts).join(marks, ["f", "t"]).withColumn("sealed", end <= newest - self.late if newest is not None else F.lit(False))

    def compact(self) -> None:
        """Merge all batches' cells into the newest one's folder by way of a table beside it. Not while the stream runs."""
        parts = self._read("cells")
        last = parts.agg(F.max("batch")).first()[0]
        merged = merge_cells(parts.withColumn("late", F.col("late")), ("f", "t", "late"))
        merged.write.mode("overwrite").parquet(f"{self.path}/compacted")
        for (k,) in parts.select("batch").distinct().where(F.col("batch") < last).collect():  # folders, not rows
            drop_path(self.spark, f"{self.path}/cells/batch={k}")
        self.spark.read.parquet(f"{self.path}/compacted").write.mode("overwrite").parquet(f"{self.path}/cells/batch={last}")
        drop_path(self.spark, f"{self.path}/compacted")


def drained_tiles(stream: DataFrame, cells: Callable[[DataFrame], DataFrame], ts: str, length_us: int, late_us: int) -> TileStore:
    """The store of a finite stream, run until its input is used up. ``ts`` is a column in microseconds."""
    spark = stream.sparkSession
    at = scratch(spark, "tiles")
    store = TileStore(spark, at, cells, ts, length_us, late_us)
    stream.writeStream.foreachBatch(store.add).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return store
