"""Ordered operators: latest rows, arrivals, runs, state machines, paths and period folds."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.sources.shared import spread, written


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, so that a busy key is met by partial results."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*keys, "__r.*")


def inter_arrival(df: DataFrame, keys: list[str], t: str, tie: str) -> DataFrame:
    return df.withColumn("gap", F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t, tie)))


def runs(df: DataFrame, keys: list[str], t: str, tie: str, state: str) -> DataFrame:
    """keys, state, first, last, n: runs of equal states in order."""
    by = Window.partitionBy(*keys).orderBy(t, tie)
    turn = F.coalesce((~F.col(state).eqNullSafe(F.lag(state).over(by))).cast("int"), F.lit(1))
    first = F.row_number().over(by) == 1
    marked = df.withColumn("__turn", F.when(first, 1).otherwise(turn)).withColumn("__run", F.sum("__turn").over(by))
    return marked.groupBy(*keys, "__run", state).agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n")).drop("__run")


def sessions(df: DataFrame, keys: list[str], t: str, idle: int) -> DataFrame:
    """keys, first, last, n: presence closed by an idle time longer than ``idle``."""
    by = Window.partitionBy(*keys).orderBy(t)
    opens = F.coalesce((F.col(t) - F.lag(t).over(by) > idle).cast("int"), F.lit(1))
    marked = df.withColumn("__opens", opens).withColumn("__s", F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__s").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count("*").alias("n")).drop("__s")


#: open, scores above, scores below, time of the last clearing (-1: none).
AlarmState = tuple[bool, int, int, int]


def hysteresis_steps(scores: list[float], times: list[int], state: AlarmState = (False, 0, 0, -1), on: float = 0.7, off: float = 0.4, raise_after: int = 2, clear_after: int = 3, reopen: int = 3_600_000_000) -> tuple[list[str], AlarmState]:
    """What each score does (raise, reopen, hold, clear or quiet), and the state it all ends in."""
    is_open, above, below, cleared = state
    out = []
    for x, t in zip(scores, times):
        if is_open:
            below = below + 1 if x < off else 0
            if below >= clear_after:
                is_open, above, below, cleared = False, 0, 0, t
                out.append("clear")
            else:
                out.append("hold")
        else:
            above = above + 1 if x >= on else 0
            if above >= raise_after:
                is_open, above, below = True, 0, 0
                out.append("reopen" if cleared >= 0 and t - cleared <= reopen else "raise")
            else:
                out.append("quiet")
    return out, (is_open, above, below, cleared)


BLOCK_ROWS = 500_000
#: A clearing time that a block doesn't know, as it lies in a block before it.
_EARLIER = -2


def hysteresis(df: DataFrame, key: str, t: str, tie: str, score: str, on: float = 0.7, off: float = 0.4, raise_after: int = 2, clear_after: int = 3, reopen: int = 3_600_000_000) -> DataFrame:
    """key, t, tie, score, step: alarms that rise after some high scores in a row and clear after some low ones.

    The table is cut into ranges of (key, t, tie) of ``BLOCK_ROWS`` rows at most, so a busy key takes as many as its rows fill. A block tells where
    each state it may start in leads; the states of a key's blocks are chained, one short row a block; then every block is
    folded from its own start. Null keys are one key, null times come last and never reopen, a null score is neither high nor
    low, full ties go by score, and each row has its step.
    """
    states = [(False, i, 0, _EARLIER) for i in range(max(raise_after, 1))] + [(True, 0, i, _EARLIER) for i in range(max(clear_after, 1))]
    none = (False, 0, 0, -1)

    def steps(frame: pd.DataFrame, state: AlarmState) -> tuple[list[str], AlarmState]:
        return hysteresis_steps(frame[score].tolist(), frame[t].tolist(), state, on, off, raise_after, clear_after, reopen)

    def of_key(frame: pd.DataFrame, at: int) -> pd.DataFrame:
        k = frame[key].iloc[at]
        return frame[frame[key].isna() if pd.isna(k) else frame[key] == k]

    def ends(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, t, tie, score])
        first, last = of_key(frame, 0), of_key(frame, -1)
        out = []
        for part, starts in ((first, states), (last, states[:1])) if len(first) < len(frame) else ((first, states),):
            led = [steps(part, s)[1] for s in starts]
            cleared = [-1 if c != c else int(c) for *_, c in led]
            out.append((part[key].iloc[0], part["__b"].iloc[0], part["__null"].iloc[0], [s[0] for s in led], [s[1] for s in led], [s[2] for s in led], cleared))
        return pd.DataFrame(out, columns=[key, "__b", "__null", "is_open", "above", "below", "cleared"])

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        state, out = none, []
        for row in frame.sort_values("__b").to_dict("records"):
            out.append((row[key], row["__b"], row["__null"], *state))
            i = states.index((*state[:3], _EARLIER))
            cleared = row["cleared"][i]
            state = (bool(row["is_open"][i]), int(row["above"][i]), int(row["below"][i]), state[3] if cleared == _EARLIER else int(cleared))
        return pd.DataFrame(out, columns=[key, "__b", "__null", "is_open", "above", "below", "cleared"])

    def fold(frame: pd.DataFrame, starts: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values([key, t, tie, score])
        told = []
        for i, (k, part) in enumerate(frame.groupby(key, sort=False, dropna=False)):
            of = starts[starts[key].isna() if pd.isna(k) else starts[key] == k] if i == 0 else starts[:0]
            start = next(of[["is_open", "above", "below", "cleared"]].itertuples(index=False, name=None), none)
            told += steps(part, start)[0]
        return frame.drop(columns=["__b", "__null"]).assign(step=told)

    narrow = df.select(key, t, tie, score)
    order = [F.asc_nulls_last(c) for c in (key, t, tie)]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // BLOCK_ROWS))
    blocks = narrow.repartitionByRange(n, *order).withColumns({"__b": F.spark_partition_id(), "__null": F.col(key).isNull()})
    blocks = written(blocks, "blocks")  # the numbers of the ranges must not change between the passes
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    where = f"{key} {narrow.schema[key].dataType.simpleString()}, __b int, __null boolean"
    led = blocks.groupBy("__b", "__null").applyInPandas(ends, f"{where}, is_open array<boolean>, above array<int>, below array<int>, cleared array<long>")
    starts = led.groupBy(key).applyInPandas(chain, f"{where}, is_open boolean, above int, below int, cleared long")
    by = ("__b", "__null")
    return blocks.groupBy(*by).cogroup(starts.groupBy(*by)).applyInPandas(fold, f"{types}, step string")


def decayed(df: DataFrame, keys: list[str], t: str, value: str, tau: float) -> DataFrame:
    """Each key's values with weights that fall exponentially with their age at the key's newest row.

    Sums are taken by stretches of time, each against its own end, so a busy key is met by partial results; a key's stretches
    are then weighted against each other.
    """
    length = 16 * tau
    age = F.exp((F.col(t) - (F.col("__b") + 1) * length) / tau)
    parts = df.withColumn("__b", F.floor(F.col(t) / length)).groupBy(*keys, "__b").agg(F.sum(F.col(value) * age).alias("__v"), F.sum(age).alias("__w"))
    newest = F.max("__b").over(Window.partitionBy(*keys))
    scaled = parts.withColumn("__s", F.exp((F.col("__b") - newest) * (length / tau)))
    return scaled.groupBy(*keys).agg((F.sum(F.col("__v") * F.col("__s")) / F.sum(F.col("__w") * F.col("__s"))).alias("persistence"))


def steps_in_level(df: DataFrame, keys: list[str], t: str, tie: str, value: str, width: int, least: float) -> DataFrame:
    """Rows where the mean of the ``width`` rows from here differs from that of the ``width`` before by ``least`` or more."""
    by = Window.partitionBy(*keys).orderBy(t, tie)
    before, after = by.rowsBetween(-width, -1), by.rowsBetween(0, width - 1)
    full = (F.count(value).over(before) == width) & (F.count(value).over(after) == width)
    return df.withColumns({"step_db": F.avg(value).over(after) - F.avg(value).over(before), "__full": full}).where(F.col("__full") & (F.abs("step_db") >= least)).drop("__full")


def sliding_minimum(df: DataFrame, keys: list[str], t: str, tie: str, value: str, width: int) -> DataFrame:
    return df.withColumn("minimum", F.min(value).over(Window.partitionBy(*keys).orderBy(t, tie).rowsBetween(-width, width)))


def fill_gaps(df: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """Missing values by a straight line between their neighbours; at the ends the nearest value."""
    by = Window.partitionBy(*keys).orderBy(at)
    back, ahead = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(at).alias("x"), F.col(value).alias("y")))
    df = df.withColumns({"__a": F.last(known, True).over(back), "__b": F.first(known, True).over(ahead)})
    a, b = F.col("__a"), F.col("__b")
    line = a["y"] + (b["y"] - a["y"]) * (F.col(at) - a["x"]) / (b["x"] - a["x"])
    return df.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(line)).drop("__a", "__b")


def tuning_legs(df: DataFrame, device: str, t: str, tie: str, centre: str, lo: str, hi: str, join: int) -> DataFrame:
    """device, centre, lo, hi, n: time at one centre, cut where the centre changes or nothing is seen for ``join``."""
    by = Window.partitionBy(device).orderBy(t, tie)
    moved = ~F.col(centre).eqNullSafe(F.lag(centre).over(by))
    apart = F.col(lo) - F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1)) > join
    opens = F.when(F.row_number().over(by) == 1, 1).otherwise((moved | F.coalesce(apart, F.lit(False))).cast("int"))
    marked = df.withColumn("__o", opens).withColumn("__leg", F.sum("__o").over(by))
    legs = marked.groupBy(device, centre, "__leg").agg(F.min(lo).alias(lo), F.max(hi).alias(hi), F.count("*").alias("n"))
    held = F.max(hi).over(Window.partitionBy(device).orderBy("__leg").rowsBetween(Window.unboundedPreceding, -1))
    return legs.withColumn(lo, F.greatest(F.col(lo), F.coalesce(held, F.col(lo)))).where(F.col(lo) <= F.col(hi)).drop("__leg")


def _chained(t: np.ndarray, anchor: int, p: float, tolerance: float) -> np.ndarray:
    """The lattice index of each time, chained from the anchor to the last one accepted on either side; NaN off the chain."""
    n = np.full(len(t), np.nan)
    n[anchor] = 0
    for side, sign in ((range(anchor + 1, len(t)), 1), (range(anchor - 1, -1, -1), -1)):
        at, k = t[anchor], 0
        for i in side:
            d = abs(t[i] - at) / p
            step = round(d)
            if step >= 1 and abs(d - step) <= tolerance:
                at, k = t[i], k + sign * step
                n[i] = k
    return n


def fold_period(times: np.ndarray, jitter: float = 0.1) -> tuple[float, float, float]:
    """Period, jitter and share of the points on the best lattice of candidate periods.

    A candidate's points are chained one to the next at twice the jitter, so that its error doesn't add up; then all
    are fitted and folded anew.
    """
    best = (0.0, 0.0, 0.0)
    if len(times) < 4:
        return best
    t = np.sort(times.astype(float))
    d = np.diff(t)
    d = d[d > 0]
    if not len(d):
        return best
    for start in (np.median(d), np.quantile(d, 0.25), np.median(d) / 2, np.median(d) / 3):
        for anchor in range(3):
            p, a = start, t[anchor]
            n = _chained(t.tolist(), anchor, float(start), 2 * jitter)
            on = ~np.isnan(n)
            for _ in range(3):
                if on.sum() < 3 or np.ptp(n[on]) == 0:
                    break
                p, a = np.polyfit(n[on], t[on], 1)
                if p <= 0:
                    break
                n = np.round((t - a) / p)
                on = np.abs(t - a - n * p) <= jitter * p
            if p <= 0:
                continue
            n = np.round((t - a) / p)
            rest = t - a - n * p
            on = np.abs(rest) <= jitter * p
            slots = np.ptp(n[on]) + 1 if on.any() else 1
            share = float(min(on.mean(), len(np.unique(n[on])) / slots))
            if share > best[2] + 1e-12:
                best = (float(p), float(np.sqrt(np.mean(rest[on] ** 2))), share)
    return best


def periods(df: DataFrame, key: str, t: str) -> DataFrame:
    """key, period, jitter, confidence of each key's times."""
    kind = df.schema[key].dataType.simpleString()

    def fold(k: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(k[0], *fold_period(frame[t].to_numpy()))], columns=[key, "period", "jitter", "confidence"])

    return spread(df.select(key, t), key).groupBy(key).applyInPandas(fold, f"{key} {kind}, period double, jitter double, confidence double")
