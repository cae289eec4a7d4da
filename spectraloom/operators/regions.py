"""Spectra by region and block: emissions measured in a region, floors of blocks, alternating runs, mirrored shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import gamma


def measured_emissions(bins: DataFrame, regions: DataFrame, keys: list[str], seed_db: float, extend_db: float, split: int = 2, share: float = 0.99, context: float = 5.0) -> DataFrame:
    """keys, region, first, last, centre, peak_db, floor_ref: what is on air in regions of spectra.

    ``bins`` has keys, bin, power, floor; ``regions`` keys, region, lo, hi (bins, half open). The reference is the upper
    median of positive floors in a window ``context`` times as wide. Runs above ``extend_db`` join over fewer than ``split``
    cells and count if a cell reaches ``seed_db``; [first, last] holds ``share`` of the excess, tails cut evenly. A region
    without bins or floors gives no row. What is gathered for a region is part of one spectrum.
    """
    pad = F.round((F.col("hi") - F.col("lo")) * (0.5 * (max(context, 1.0) - 1.0)))
    near = bins.join(regions, keys).where((F.col("bin") >= F.col("lo") - pad) & (F.col("bin") < F.col("hi") + pad))
    inside = (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi"))
    floors = F.sort_array(F.collect_list(F.when((F.col("floor") > 0) & (F.col("floor") < float("inf")), F.col("floor"))))
    whole = near.groupBy(*keys, "region").agg(floors.alias("f"), F.collect_list(F.when(inside, F.struct("bin", "power"))).alias("b")).where(F.size("f") > 0)
    cells = whole.select(*keys, "region", F.col("f")[F.floor(F.size("f") / 2).cast("int")].alias("floor_ref"), F.inline("b"))
    cells = cells.withColumns({"db": 10 * F.log10(F.greatest(F.col("power") / F.col("floor_ref"), F.lit(1e-30))), "excess": F.greatest(F.col("power") - F.col("floor_ref"), F.lit(0.0))})
    by = Window.partitionBy(*keys, "region").orderBy("bin")
    hot = F.col("db") >= extend_db
    before = F.last(F.when(hot, F.col("bin")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = (hot & (before.isNull() | (F.col("bin") - before - 1 >= max(split, 1)))).cast("int")
    cells = cells.withColumn("opens", opens).withColumn("run", F.sum("opens").over(by)).where("run > 0")
    run = Window.partitionBy(*keys, "region", "run")
    cells = cells.withColumn("end", F.max(F.when(hot, F.col("bin"))).over(run)).where("bin <= end")
    total = F.sum("excess").over(run)
    up = F.sum("excess").over(run.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    down = F.sum("excess").over(run.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"up": up, "down": down, "tail": total * (0.5 * (1 - share))})
    found = cells.groupBy(*keys, "region", "run").agg(
        F.min(F.when(F.col("up") >= F.col("tail"), F.col("bin"))).alias("first"),
        F.max(F.when(F.col("down") >= F.col("tail"), F.col("bin"))).alias("last"),
        (F.sum(F.col("bin") * F.col("excess")) / F.nullif(F.sum("excess"), F.lit(0.0))).alias("centre"),
        F.max("db").alias("peak_db"),
        F.first("floor_ref").alias("floor_ref"),
    )
    return found.where((F.col("peak_db") >= seed_db) & F.col("centre").isNotNull()).drop("run")


def block_floors(bins: DataFrame, keys: list[str], block: Column, power: str, averages: float, quantile: float = 0.25, false_alarm: float = 1e-3, fullest: float = 0.5) -> DataFrame:
    """keys, block, floor, occupancy, valid: a percentile of a block's positive bins, free of the bias that averaging leaves.

    A block without positive bins has no floor and counts as occupied. What is gathered is one block.
    """
    factor, over = block_factors(averages, quantile, false_alarm)
    good = bins.withColumn("p", F.when((F.col(power) > 0) & (F.col(power) < float("inf")), F.col(power)))
    got = good.groupBy(*keys, block.alias("block")).agg(F.percentile("p", quantile).alias("q"), F.collect_list("p").alias("ps"))
    got = got.withColumn("floor", F.greatest(F.col("q") / factor, F.lit(1e-37)) + F.when(F.col("q").isNotNull(), 0.0))
    above = F.size(F.filter("ps", lambda x: x > F.col("floor") * over)) / F.nullif(F.size("ps"), F.lit(0))
    got = got.withColumn("occupancy", F.coalesce(above, F.lit(1.0)))
    return got.select(*keys, "block", "floor", "occupancy", (F.col("floor").isNotNull() & (F.col("occupancy") < fullest)).alias("valid"))


def block_factors(averages: float, quantile: float, false_alarm: float) -> tuple[float, float]:
    """The percentile of noise of mean one, and the multiple of the mean that noise passes at the false-alarm rate."""
    low, high = (float(gamma.upper_inverse(averages, q)[0]) / averages for q in (1 - quantile, false_alarm))
    return low, high


def alternating_run(bits: Column) -> Column:
    """The first of the longest alternating runs of a text of bits; null if there is none of two bits or more."""
    found = F.regexp_extract_all(bits, F.lit("((?:01)+0?|(?:10)+1?)"), 1)
    longest = F.array_max(F.transform(found, lambda x: F.length(x)))
    return F.get(F.filter(found, lambda x: F.length(x) == longest), F.lit(0))


def preamble(bits: Column, least: int) -> Column:
    """struct(start, length) of the alternating run that leads a frame, from 0; null where all are shorter."""
    run = alternating_run(bits)
    return F.when(F.length(run) >= least, F.struct((F.instr(bits, run) - 1).alias("start"), F.length(run).alias("length")))


def mirror_correlation(x: Column) -> Column:
    """Correlation of an array's lower half, read outwards from the middle, with its upper half; null where one is flat."""
    half = F.floor(F.size(x) / 2).cast("int")
    up = F.slice(x, F.size(x) - half + 1, half)
    down = F.reverse(F.slice(x, 1, half))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    mean = lambda a: total(a) / F.nullif(half, F.lit(0))
    cross = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q)) - total(a) * mean(b)
    return cross(up, down) / F.nullif(F.sqrt(cross(up, up) * cross(down, down)), F.lit(0.0))
