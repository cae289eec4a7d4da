"""Interval algebra: merging, gaps, clipping, differences and range joins.

Merging runs in two steps: intervals that start in one block of the axis are merged by block, then the blocks' islands by
key, so a busy key is spread over tasks first and only its islands meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.sources.shared import spread


def overlaps(a_lo: Column, a_hi: Column, b_lo: Column, b_hi: Column) -> Column:
    """Closed intervals meet, touching included."""
    return (a_lo <= b_hi) & (a_hi >= b_lo)


def clipped_length(lo: Column, hi: Column, span_lo: Column, span_hi: Column) -> Column:
    return F.greatest(F.lit(0), F.least(hi, span_hi) - F.greatest(lo, span_lo))


def _islands(df: DataFrame, keys: list[str], lo: str, hi: str, strict: bool, flags: list[str], count: str) -> DataFrame:
    by = Window.partitionBy(*keys).orderBy(lo, hi)
    before = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col(lo) >= before if strict else F.col(lo) > before
    marked = df.withColumn("__island", F.sum(F.coalesce(opens.cast("int"), F.lit(1))).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.sum(count).alias(count), *(F.bool_or(f).alias(f) for f in flags)).drop("__island")


def merge(df: DataFrame, keys: list[str], lo: str, hi: str, block: int | None = None, strict: bool = False, flags: list[str] | None = None) -> DataFrame:
    """keys, lo, hi, n (intervals merged) and the flags, true where any part's is.

    Touching intervals join, unless ``strict``. ``block`` is the length of the axis by which work is first spread. Intervals are
    few bytes in a shuffle and many in a sort, so tasks aren't joined by their bytes.
    """
    flags = flags or []
    df = df.where(F.col(lo).isNotNull() & F.col(hi).isNotNull()).select(*keys, lo, hi, F.lit(1).cast("long").alias("n"), *flags)
    if block:
        df = spread(df.withColumn("__block", F.floor(F.col(lo) / block)), *keys, "__block")
        df = _islands(df, [*keys, "__block"], lo, hi, strict, flags, "n").drop("__block")
    return _islands(spread(df, *keys) if keys else df, keys, lo, hi, strict, flags, "n")


def gaps(merged: DataFrame, keys: list[str], lo: str, hi: str, span_lo, span_hi, least: int = 1, asked: DataFrame | None = None) -> DataFrame:
    """keys, gap_lo, gap_hi: what merged intervals leave open in the span, its edges included, at least ``least`` long.

    ``merged`` must be disjoint by key. Keys of ``asked`` without an interval in the span have the whole span as a gap.
    """
    inside = merged.where((F.col(hi) > span_lo) & (F.col(lo) < span_hi))
    by = Window.partitionBy(*keys).orderBy(lo)
    before = inside.select(*keys, F.coalesce(F.lag(hi).over(by), F.lit(span_lo)).alias("gap_lo"), F.col(lo).alias("gap_hi"))
    after = inside.groupBy(*keys).agg(F.max(hi).alias("gap_lo")).withColumn("gap_hi", F.lit(span_hi))
    found = before.unionByName(after)
    if asked is not None:
        none = asked.select(*keys).distinct().join(inside.select(*keys).distinct(), keys, "left_anti")
        found = found.unionByName(none.select(*keys, F.lit(span_lo).alias("gap_lo"), F.lit(span_hi).alias("gap_hi")))
    return found.where(F.col("gap_hi") - F.col("gap_lo") >= max(least, 1))


def subtract(df: DataFrame, lo: str, hi: str, cut_lo: str, cut_hi: str) -> DataFrame:
    """What is left of [lo, hi] without [cut_lo, cut_hi]: no, one or two rows each."""
    none = F.col(cut_lo).isNull() | (F.col(cut_hi) <= F.col(lo)) | (F.col(cut_lo) >= F.col(hi))
    part = lambda a, b: F.struct(a.alias("lo"), b.alias("hi"))
    pieces = F.when(none, F.array(part(F.col(lo), F.col(hi)))).otherwise(F.array(part(F.col(lo), F.col(cut_lo)), part(F.col(cut_hi), F.col(hi))))
    return df.withColumn("__p", F.explode(pieces)).withColumns({lo: F.col("__p.lo"), hi: F.col("__p.hi")}).drop("__p").where(F.col(lo) < F.col(hi))


def range_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], lo: tuple[str, str], hi: tuple[str, str], cell: int, contains: bool = False) -> DataFrame:
    """Pairs whose closed intervals overlap (or whose right interval contains the left one), by equal keys and cells.

    Each interval is laid on the cells it touches; a pair is kept only in the cell where the later of the two begins, so
    it comes once. ``cell`` should be about a usual interval's length.
    """
    cells = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell)))
    a = left.where(F.col(lo[0]) <= F.col(hi[0])).withColumn("__cell", cells(lo[0], hi[0]))  # an interval that ends before it begins meets none
    b = right.where(F.col(lo[1]) <= F.col(hi[1])).withColumn("__cell_r", cells(lo[1], hi[1]))
    meet = overlaps(F.col(lo[0]), F.col(hi[0]), F.col(lo[1]), F.col(hi[1]))
    if contains:
        meet = meet & (F.col(lo[1]) <= F.col(lo[0])) & (F.col(hi[1]) >= F.col(hi[0]))
    once = F.col("__cell") == F.floor(F.greatest(lo[0], lo[1]) / cell)
    same = F.col("__cell") == F.col("__cell_r")
    for x, y in on:
        same = same & (F.col(x) == F.col(y))
    return a.join(b, same & once & meet).drop("__cell", "__cell_r")


def totals(visits: DataFrame, keys: list[str], lo: str, hi: str, tier: str, tiers: list[str], span_lo: int, span_hi: int, block: int, independent: list[str] | None = None) -> DataFrame:
    """n_visits, n_independent, mean_revisit, longest gap and seconds of each tier, of every key that ``visits`` holds.

    Tier sums count raw visits clipped to the span, so overlaps count twice; visits and revisits count merged ones with a
    positive part in the span, from their unclipped starts; a merged visit is independent of activity if any part has one of
    the ``independent`` tiers; the mean revisit is at most the span. A key that isn't visited in the span has no visit, no
    revisit and a gap as long as the span.
    """
    seen = (F.col(hi) > span_lo) & (F.col(lo) < span_hi) & (F.col(hi) > F.col(lo))
    clip = clipped_length(F.col(lo), F.col(hi), F.lit(span_lo), F.lit(span_hi))
    every = visits.groupBy(*keys).agg(*(F.sum(F.when(seen & (F.col(tier) == t), clip).otherwise(0)).alias(f"{t}_us") for t in tiers))
    free = F.coalesce(F.col(tier).isin(*(independent or [])), F.lit(False))
    islands = merge(visits.where(seen).withColumn("__free", free), keys, lo, hi, block, flags=["__free"])
    before = F.coalesce(F.lag(hi).over(Window.partitionBy(*keys).orderBy(lo)), F.lit(span_lo))
    revisit = (F.max(lo) - F.min(lo)) / (F.count("*") - 1)
    counted = islands.withColumn("__gap", F.col(lo) - before).groupBy(*keys).agg(
        F.count("*").alias("n_visits"),
        F.count_if("__free").alias("n_independent"),
        F.when(F.count("*") > 1, F.least(revisit, F.lit(float(span_hi - span_lo)))).alias("mean_revisit_us"),
        F.greatest(F.max("__gap"), span_hi - F.max(hi)).alias("longest_gap_us"),
    )
    out = every.join(counted, keys, "left").fillna(0, ["n_visits", "n_independent", *(f"{t}_us" for t in tiers)])
    gap = F.when(F.col("n_visits") == 0, F.lit(span_hi - span_lo)).when(F.col("longest_gap_us") > 0, F.col("longest_gap_us"))
    return out.select(*keys, "n_visits", "n_independent", "mean_revisit_us", *(f"{t}_us" for t in tiers), gap.alias("longest_gap_us"))


def intercept_share(visits: DataFrame, keys: list[str], lo: str, hi: str, lead: int, span_lo: int, span_hi: int, block: int) -> DataFrame:
    """Probability of intercept: the share of the span from which an event of length ``lead`` would meet a visit."""
    wide = visits.select(*keys, F.greatest(F.col(lo) - lead, F.lit(span_lo)).alias(lo), F.least(F.col(hi), F.lit(span_hi)).alias(hi)).where(F.col(lo) < F.col(hi))
    islands = merge(wide, keys, lo, hi, block)
    return islands.groupBy(*keys).agg((F.sum(F.col(hi) - F.col(lo)) / float(max(span_hi - span_lo, 1))).alias("poi"))
