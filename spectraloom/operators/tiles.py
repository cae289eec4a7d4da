"""Tiles of a time-frequency pyramid that merge: partial cells add up in any order, histograms give their percentiles.

A partial cell is what any set of rows says about a cell; merging partial cells of disjoint rows gives the cell of all of them,
so late rows are one more partial cell. Histograms are sparse maps from bin to count. A fold carries them where the parent's
column covers whole child tiles, and then gives percentiles; elsewhere they are null, as a part of a tile's histogram isn't known.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.scalar import from_db


@dataclass(frozen=True)
class Bins:
    """Even bins whose ends are clamped; NaN and null go to the lowest."""

    lo: float
    step: float
    n: int

    def of(self, x: Column) -> Column:
        return F.when(x.isNull() | F.isnan(x), 0).otherwise(F.least(F.greatest(F.floor((x - self.lo) / self.step), F.lit(0)), F.lit(self.n - 1))).cast("int")


def _summed(hist: str) -> Column:
    """The sum of sparse histograms, in order of bins, once they are laid out as rows of (bin, n)."""
    return F.map_from_entries(F.array_sort(F.collect_list(F.struct("bin", hist))))


def partial_cells(df: DataFrame, f: Column, t: Column, value: str, seconds: Column, occupied: Column, bins: Bins) -> DataFrame:
    """f, t, n, max_db, power (linear sum), cover_s, occupied_s, hist of the rows of each cell."""
    x = F.col(value)
    by_bin = df.groupBy(f.alias("f"), t.alias("t"), bins.of(x).alias("bin")).agg(
        F.count("*").alias("n"),
        F.max(x).alias("max_db"),
        F.sum(from_db(x)).alias("power"),
        F.sum(seconds).alias("cover_s"),
        F.sum(F.when(occupied, seconds).otherwise(0.0)).alias("occupied_s"),
    )
    sums = [F.sum(c).alias(c) for c in ("power", "cover_s", "occupied_s")]
    return by_bin.groupBy("f", "t").agg(_summed("n").alias("hist"), F.sum("n").alias("n"), F.max("max_db").alias("max_db"), *sums)


def merge_cells(cells: DataFrame, keys: tuple[str, ...] = ("f", "t")) -> DataFrame:
    """Partial cells of disjoint rows merged; order and grouping don't matter (but for the rounding of sums)."""
    sums = [F.sum(c).alias(c) for c in ("n", "power", "cover_s", "occupied_s")]
    whole = cells.groupBy(*keys).agg(*sums, F.max("max_db").alias("max_db"), F.bool_or(F.col("hist").isNull()).alias("lost"))
    return whole.join(_merged(cells, keys), list(keys), "left").withColumn("hist", F.when(~F.col("lost"), F.col("hist"))).drop("lost")


def _merged(cells: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    counts = cells.select(*keys, F.explode("hist").alias("bin", "k")).groupBy(*keys, "bin").agg(F.sum("k").alias("k"))
    return counts.groupBy(*keys).agg(_summed("k").alias("hist"))


def with_shares(cells: DataFrame) -> DataFrame:
    """Level-0 cells with ``max_share``, the occupied share of the covered time."""
    return cells.withColumn("max_share", F.coalesce(F.least(F.col("occupied_s") / F.nullif(F.col("cover_s"), F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def fold_tiles(level: DataFrame, f_factor: int, t_factor: int, tile: int) -> DataFrame:
    """The next level of cells with ``max_share``; a child tile is ``tile`` columns of time long.

    Counts and powers add up, maxima keep, coverage is the children's sum over the frequency factor, and what is occupied is the
    best child's share of it. Histograms survive where ``t_factor`` is a multiple of ``tile``.
    """
    parent = level.withColumns({"f": F.floor(F.col("f") / f_factor), "t": F.floor(F.col("t") / t_factor)})
    cover = F.sum("cover_s") / f_factor
    best = F.coalesce(F.max(F.col("occupied_s") / F.nullif(F.col("cover_s"), F.lit(0.0))), F.lit(0.0))
    lost = F.bool_or(F.col("hist").isNull()).alias("lost")
    sums = parent.groupBy("f", "t").agg(F.sum("n").alias("n"), F.max("max_db").alias("max_db"), F.sum("power").alias("power"), cover.alias("cover_s"), (best * cover).alias("occupied_s"), F.max("max_share").alias("max_share"), lost)
    if t_factor % tile:
        return sums.drop("lost").withColumn("hist", F.lit(None).cast("map<int,bigint>"))
    return sums.join(_merged(parent, ("f", "t")), ["f", "t"], "left").withColumn("hist", F.when(~F.col("lost"), F.col("hist"))).drop("lost")


def hist_percentile(hist: Column, q: float, bins: Bins) -> Column:
    """The percentile of a sparse histogram: the first bin whose running count reaches ``q`` % of all, its mass spread evenly."""
    entries = F.array_sort(F.map_entries(hist))
    total = F.aggregate(entries, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    rank = total * (q / 100)
    start = F.struct(F.lit(0).cast("long").alias("run"), F.lit(None).cast("double").alias("at"))

    def step(a: Column, e: Column) -> Column:
        run = a["run"] + e["value"]
        inside = bins.lo + bins.step * (e["key"] + F.greatest(F.lit(0.0), rank - a["run"]) / e["value"])
        return F.struct(run.alias("run"), F.when(a["at"].isNotNull(), a["at"]).when(run >= rank, inside).alias("at"))

    return F.aggregate(entries, start, step)["at"]
