"""Relations between entities: harmonic lines, retuning receivers, allocations, recurrence, matching against truth."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Slopes of centre against oscillator that a receiver's own products can have. Fixed values.
SLOPES = (0.0, 1.0, 2.0)


def harmonic_line(df: DataFrame, keys: list[str], index: str, f: str) -> DataFrame:
    """Least squares of a frequency on its harmonic number: spacing, offset, sigma (k - 2 degrees of freedom), n."""
    n, x, y = F.count("*"), F.col(index).cast("double"), F.col(f)
    slope, offset = F.regr_slope(y, x), F.regr_intercept(y, x)
    sse = F.regr_syy(y, x) - slope * F.regr_sxy(y, x)
    return df.groupBy(*keys).agg(slope.alias("spacing"), offset.alias("offset"), F.when(n > 2, F.sqrt(F.greatest(sse, F.lit(0.0)) / (n - 2))).alias("sigma"), n.alias("n"))


def distinct_pairs(left: DataFrame, right: DataFrame, a: str, b: str, on: list[str]) -> DataFrame:
    """Distinct a, b of rows with equal values of ``on``. Ids aren't null.

    A pair can come twice only where both its ids have several values, so repeats are dropped before the join, and after it only
    among such ids' pairs; what else the join gives isn't held.
    """

    def once(df: DataFrame, c: str) -> DataFrame:
        rows = df.select(c, *on).dropna().distinct()
        return rows.withColumn(f"__{c}", F.count("*").over(Window.partitionBy(c)) > 1)

    one, two = once(left, a), once(right, b)
    several = F.col(f"__{a}") & F.col(f"__{b}")
    pairs = one.join(two, on).where(~several).select(a, b)
    return pairs.unionByName(one.where(f"__{a}").join(two.where(f"__{b}"), on).select(a, b).distinct())


def retune_groups(centres: np.ndarray, oscillators: np.ndarray, width: float, least: int) -> np.ndarray:
    """For each centre the slope index it is claimed by, or -1.

    By each slope the coordinates ``centre - slope * oscillator`` are chained where neighbours are within ``width``. Chains
    claim their centres in the order of most oscillators, least spread, slope; a chain left with too few is dropped.
    """
    chains = []
    for s, slope in enumerate(SLOPES):
        c = centres - slope * oscillators
        order = np.argsort(c, kind="stable")
        for chain in np.split(order, np.flatnonzero(np.diff(c[order]) > width) + 1):
            chains.append((-len(np.unique(oscillators[chain])), float(np.ptp(c[chain])), s, chain))
    claimed = np.full(len(centres), -1)
    for _, _, s, chain in sorted(chains, key=lambda x: x[:3]):
        free = chain[claimed[chain] < 0]
        if len(np.unique(oscillators[free])) >= least:
            claimed[free] = s
    return claimed


def retune(df: DataFrame, key: str, row: str, centre: str, oscillator: str, width: float, least: int = 3) -> DataFrame:
    """key, row, slope: how each detection of a device moves with its oscillator; null where no rule claims it.

    The claim is ordered and greedy, one device at a time; a device's centres within one sweep are a bounded group.
    """
    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, row)}

    def claim(k: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([centre, row])
        found = retune_groups(frame[centre].to_numpy(float), frame[oscillator].to_numpy(float), width, least)
        return pd.DataFrame({key: k[0], row: frame[row], "slope": pd.array([SLOPES[s] if s >= 0 else None for s in found], dtype="Float64")})

    return df.select(key, row, centre, oscillator).groupBy(key).applyInPandas(claim, f"{key} {kinds[key]}, {row} {kinds[row]}, slope double")


MOST_ALLOCATIONS = 100_000


def allocated(df: DataFrame, at: str, table: DataFrame, lo: str, hi: str, rank: str) -> DataFrame:
    """``df`` with the row of highest rank (then highest ``lo``) of an allocation table that holds ``at``; nulls where none does.

    The allocations are cut at all their ends into stretches that have one best row each, and the stretches are laid on even
    cells, four times as many as stretches; a row looks only at its cell's. The cells travel by broadcast; ``MOST_ALLOCATIONS`` rows bound them.
    Allocations that end before they begin hold nothing.
    """
    rest = [c for c in table.columns if c not in (lo, hi)]
    if table.limit(MOST_ALLOCATIONS + 1).count() > MOST_ALLOCATIONS:
        raise ValueError(f"an allocation table has at most {MOST_ALLOCATIONS} rows")
    kept = table.where(F.col(lo) < F.col(hi))
    ends = kept.select(F.explode(F.array(lo, hi)).alias("p")).distinct()
    first, last, n = ends.agg(F.min("p"), F.max("p"), F.count("*")).first()
    if not n:
        return df.select(*df.columns, *(F.lit(None).cast(table.schema[c].dataType).alias(c) for c in rest))
    by = Window.orderBy("p")  # of twice the allocations at most
    points = ends.select("p", F.row_number().over(by).alias("i"), F.lead("p").over(by).alias("q"))
    spans = kept.join(points.select(F.col("p").alias(lo), F.col("i").alias("a")), lo).join(points.select(F.col("p").alias(hi), F.col("i").alias("b")), hi)
    best = F.max(F.struct(F.col(rank).alias("rank"), F.col(lo).alias("lo"), F.struct(*rest).alias("rest"))).alias("m")
    held = spans.withColumn("i", F.explode(F.sequence(F.col("a"), F.col("b") - 1))).groupBy("i").agg(best)
    width = (last - first) / (4 * n)
    cell = lambda c: F.floor((F.col(c) - first) / width)
    laid = held.join(points, "i").select(F.col("p").alias("lo"), F.col("q").alias("hi"), F.col("m.rest").alias("rest"), F.explode(F.sequence(cell("p"), cell("q"))).alias("__cell"))
    cells = laid.groupBy("__cell").agg(F.collect_list(F.struct("lo", "hi", "rest")).alias("__held"))
    mine = F.get(F.filter("__held", lambda r: (F.col(at) >= r["lo"]) & (F.col(at) < r["hi"])), F.lit(0))
    looked = df.withColumn("__at", cell(at)).join(F.broadcast(cells), F.col("__at") == F.col("__cell"), "left")
    return looked.withColumn("__a", mine["rest"]).select(*df.columns, "__a.*")


def recurrence(df: DataFrame, key: str, lo: str, hi: str, duty: Column, newest: int) -> DataFrame:
    """first, last, appearances, on-air time, duty over the whole, and the starts of the newest appearances."""
    on_air = F.sum((F.col(hi) - F.col(lo)) * duty)
    by = Window.partitionBy(key).orderBy(F.desc(lo))
    latest = df.withColumn("__i", F.row_number().over(by)).where(F.col("__i") <= newest).groupBy(key).agg(F.sort_array(F.collect_list(lo), False).alias("newest"))
    whole = df.groupBy(key).agg(F.min(lo).alias("first"), F.max(hi).alias("last"), F.count("*").alias("appearances"), on_air.alias("on_air"))
    return whole.withColumn("duty", F.least(F.col("on_air") / F.greatest(F.col("last") - F.col("first"), F.lit(1)), F.lit(1.0))).join(latest, key)


def measurement(a: tuple[Column, Column], b: tuple[Column, Column], n: Column) -> Column:
    """Two cursors (time in s, frequency) and a count: differences, rate and period."""
    dt, df = F.abs(b[0] - a[0]), F.abs(b[1] - a[1])
    return F.struct(dt.alias("dt"), df.alias("df"), F.when(dt > 0, n / dt).alias("rate"), F.when(n > 0, dt / n).alias("period"))


def anomalies_suppressed(mobile: Column, unassigned: Column, explained: Column, immature: Column) -> Column:
    """Why an alarm is held back, the first reason that applies."""
    return F.when(mobile, "mobile").when(unassigned, "unassigned").when(explained, "provenance").when(immature, "immature")


def episodes(df: DataFrame, key: str, t: str, tie: str, high: Column, gap: int) -> DataFrame:
    """Floor episodes: stretches of high rows of a key that are less than ``gap`` apart."""
    from spectraloom.operators.sequences import sessions

    return sessions(df.where(high).select(key, t), [key], t, gap)
