"""Routes through time and frequency: ramps, repeated ramps and hop sequences traced through detections."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.sources.shared import spread


@dataclass(frozen=True)
class PathRule:
    """Tolerances, in shares of the detections' own widths and durations."""

    gap: float = 0.25
    least_gap: float = 0.010
    step: float = 0.5
    touch: float = 0.35
    excursion: float = 1.0
    ramp: int = 3
    hops: int = 5
    channels: int = 3
    alike: float = 2.0
    overlap: float = 0.5


class _Stretch:
    """The detections of one busy stretch as columns by start, and which of them no path has claimed."""

    def __init__(self, frame: pd.DataFrame, rule: PathRule):
        frame = frame.sort_values(["start", "f", "id"], kind="stable")
        self.id, self.start, self.end, self.f, self.w = (frame[c].to_numpy() for c in ("id", "start", "end", "f", "w"))
        self.long = self.end - self.start
        self.gap = np.maximum(rule.gap * self.long, rule.least_gap)
        self.free = np.ones(len(frame), bool)
        self.rule = rule

    def touches(self, i, j):
        room = (self.w[i] + self.w[j]) / 2 + self.rule.touch * np.maximum(self.w[i], self.w[j])
        return np.abs(self.f[j] - self.f[i]) <= room

    def climbs(self, i, j, step):
        moved = self.f[j] - self.f[i]
        far = np.abs(moved) >= self.rule.step * np.maximum(self.w[i], self.w[j])
        return self.touches(i, j) & far & ((step == 0) | (np.sign(moved) == np.sign(step)))

    def hops(self, i, j, step):
        ratio = lambda x: np.maximum(x[i], x[j]) / np.maximum(np.minimum(x[i], x[j]), 1e-12)
        return (np.abs(self.f[j] - self.f[i]) >= (self.w[i] + self.w[j]) / 2) & (ratio(self.long) <= self.rule.alike) & (ratio(self.w) <= self.rule.alike)

    def chain(self, first: int, link) -> list[int]:
        """From ``first`` on, the free follower with the least gap, then the least step."""
        out, step = [first], 0.0
        while True:
            i = out[-1]
            j = np.arange(i + 1, np.searchsorted(self.start, self.end[i] + self.gap[i], side="right"))
            j = j[self.free[j] & (self.start[j] >= self.start[i] + self.long[i] / 4)]
            j = j[link(i, j, step)]
            if not len(j):
                return out
            best = int(j[np.lexsort((np.abs(self.f[j] - self.f[i]), np.abs(self.start[j] - self.end[i])))[0]])
            step = self.f[best] - self.f[i]
            out.append(best)

    def claim(self, link, good) -> list[list[int]]:
        """The good chains; the members of others are free again once all are built."""
        chains = []
        for first in range(len(self.id)):
            if self.free[first] and len(members := self.chain(first, link)) > 1:
                self.free[members] = False
                chains.append(members)
        found = [c for c in chains if good(c)]
        for c in chains:
            self.free[c] = not good(c)
        return found

    def ramp(self, members) -> bool:
        return len(members) >= self.rule.ramp and abs(self.f[members[-1]] - self.f[members[0]]) >= self.rule.excursion * np.median(self.w[members])

    def hop(self, members) -> bool:
        if len(members) < self.rule.hops:
            return False
        width, channel, seen = np.median(self.w[members]), [], 0
        for f in np.sort(self.f[members]):
            if not channel or f - np.mean(channel) > width:  # a channel's dwells lie within a width of their mean
                channel, seen = [], seen + 1
            channel.append(f)
        return seen >= self.rule.channels

    def span(self, members):
        return (self.f[members] - self.w[members] / 2).min(), (self.f[members] + self.w[members] / 2).max()

    def repeats(self, a, b) -> bool:
        """Whether ramp ``b`` goes on from ``a``: a repeat in the same direction, or a turn where ``a`` stopped."""
        i, j = a[-1], b[0]
        if not -self.long[i] / 2 <= self.start[j] - self.end[i] <= self.gap[i]:
            return False
        if np.sign(self.f[a[-1]] - self.f[a[0]]) != np.sign(self.f[b[-1]] - self.f[b[0]]):
            return bool(self.touches(i, j))
        (alo, ahi), (blo, bhi) = self.span(a), self.span(b)
        return min(ahi, bhi) - max(alo, blo) >= self.rule.overlap * min(ahi - alo, bhi - blo)

    def sweeps(self, ramps: list[list[int]]) -> list[list[list[int]]]:
        groups, left = [], list(ramps)
        while left:
            group = [left.pop(0)]
            while (after := next((k for k, r in enumerate(left) if self.repeats(group[-1], r)), None)) is not None:
                group.append(left.pop(after))
            groups.append(group)
        return groups


def _trace(device: str, rule: PathRule):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        s = _Stretch(frame, rule)
        found = [("sweep" if len(g) > 1 else "chirp", len(g), sum(g, [])) for g in s.sweeps(s.claim(s.climbs, s.ramp))]
        found += [("hop", 1, m) for m in s.claim(s.hops, s.hop)]
        rows = [(frame[device].iloc[0], kind, parts, s.start[m].min(), s.end[m].max(), *s.span(m), len(m), s.id[m].tolist()) for kind, parts, m in found]
        return pd.DataFrame(rows, columns=[device, "kind", "parts", "first", "last", "lo", "hi", "n", "members"])

    return run


def traced_paths(detections: DataFrame, device: str, row: str, start: str, end: str, centre: str, width: str, rule: PathRule = PathRule()) -> DataFrame:
    """device, kind (chirp, sweep or hop), parts, first, last, lo, hi, n, members in order: the routes that detections trace.

    No link crosses a silence longer than every open detection's gap, so a device's time is cut there first and each busy
    stretch is traced by itself; claims within it are ordered, so a stretch is one group. Times are in seconds.
    Detections with a null, without length or without width trace nothing. ``row`` is unique and a bigint.
    """
    d = detections.select(device, F.col(row).alias("id"), *[F.col(c).cast("double").alias(a) for c, a in ((start, "start"), (end, "end"), (centre, "f"), (width, "w"))]).where("id is not null and end > start and w > 0 and f is not null")
    d = spread(d, device)
    by = Window.partitionBy(device).orderBy("start", "f", "id")
    reach = F.max(F.col("end") + F.greatest(rule.gap * (F.col("end") - F.col("start")), F.lit(rule.least_gap))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    d = d.withColumn("__new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1))).withColumn("__stretch", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    kind = detections.schema[device].dataType.simpleString()
    return d.groupBy(device, "__stretch").applyInPandas(_trace(device, rule), f"{device} {kind}, kind string, parts long, first double, last double, lo double, hi double, n long, members array<bigint>")
