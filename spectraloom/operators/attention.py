"""What to look at next: features of emissions, accumulated evidence, windows packed by score, and rankings that are published when they change."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.carried import carried


def emission_features(df: DataFrame, keys: list[str], name: str, value: str, sigma: str, text: str, suspect: str) -> DataFrame:
    """keys, name, n, n_suspect, value, spread, low, high, label: what an emission's observations of each name say together.

    Suspect observations are counted but not used. ``value`` is the mean and ``spread`` the root of the sample variance and the mean
    squared sigma of the observations; text observations give their commonest text, the least of equals. All of it is made of
    partial sums and counts.
    """
    used = ~F.coalesce(F.col(suspect), F.lit(False))
    x, s = F.when(used, F.col(value)), F.when(used, F.coalesce(F.col(sigma), F.lit(0.0)))
    numbers = df.groupBy(*keys, name).agg(
        F.count_if(used).alias("n"),
        F.count_if(~used).alias("n_suspect"),
        F.avg(x).alias("value"),
        F.sqrt(F.coalesce(F.var_samp(x), F.lit(0.0)) + F.avg(F.when(x.isNotNull(), s * s))).alias("spread"),
        F.min(x).alias("low"),
        F.max(x).alias("high"),
    )
    texts = df.where(used & F.col(text).isNotNull()).groupBy(*keys, name, F.col(text).alias("label")).agg(F.count("*").alias("__n"))
    common = texts.groupBy(*keys, name).agg(F.min_by("label", F.struct(-F.col("__n"), F.col("label"))).alias("label"))
    same = F.lit(True)
    for k in [*keys, name]:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return numbers.alias("a").join(common.alias("b"), same, "left").select("a.*", "b.label")


def accumulated_evidence(df: DataFrame, keys: list[str], group: str, bits: str) -> DataFrame:
    """keys, bits, n, n_groups: evidence of independent groups adds up; within a group only its strongest counts, a null group is each row's own.

    Bits that aren't finite count as none.
    """
    b = F.when(F.abs(F.col(bits)) < float("inf"), F.col(bits))
    own = df.where(F.col(group).isNull()).groupBy(*keys).agg(F.sum(b).alias("b"), F.count(b).alias("n"), F.count(b).alias("g"))
    best = df.where(F.col(group).isNotNull()).groupBy(*keys, group).agg(F.max(b).alias("b"), F.count(b).alias("n")).where("n > 0")
    shared = best.groupBy(*keys).agg(F.sum("b").alias("b"), F.sum("n").alias("n"), F.count("*").alias("g"))
    return own.unionByName(shared).groupBy(*keys).agg(F.coalesce(F.sum("b"), F.lit(0.0)).alias("bits"), F.sum("n").alias("n"), F.sum("g").alias("n_groups"))


#: Columns that ``WindowFold`` takes, the best score first, and what it gives: the window's number, centre and members, and each member's score.
ITEM = ["rank", "lo", "hi", "score"]
WINDOWS = "window int, centre double, item long, lead boolean, on_centre boolean"


class WindowFold:
    """Items packed into windows by score: rows (rank from the best score, lo, hi, score) of one receiver.

    The best item that isn't packed leads a window. The window's centre lies on a grid, so that the lead is inside the usable span and
    clear of the centre by the guard, and where the other unpacked items that fit sum up to the highest score; the lowest such centre
    of equals. A lead that fits nowhere gets a window around itself, alone. The state is the receiver's items.
    """

    def __init__(self, usable: float, quantum: float, guard: float):
        self.usable, self.quantum, self.guard = usable, quantum, guard

    def start(self) -> list:
        return []

    def step(self, state: list, row: tuple) -> tuple:
        state.append(list(row))
        return ()

    def _fits(self, item: list, centre: float) -> bool:
        _, lo, hi, _ = item
        half = self.usable / 2
        return lo >= centre - half and hi <= centre + half and (lo >= centre + self.guard or hi <= centre - self.guard)

    def end(self, state: list) -> Iterator[tuple]:
        left, number = sorted(state, key=lambda i: i[0]), 0
        while left:
            lead, *others = left
            half = self.usable / 2
            first, last = math.ceil((lead[2] - half) / self.quantum), math.floor((lead[1] + half) / self.quantum)
            best = None
            for k in range(first, last + 1):
                centre = k * self.quantum
                if self._fits(lead, centre):
                    members = [i for i in others if self._fits(i, centre)]
                    total = math.fsum(i[3] for i in members)
                    if best is None or total > best[0]:
                        best = (total, centre, members)
            _, centre, members = best or (0.0, (lead[1] + lead[2]) / 2, [])
            for i in (lead, *members):
                yield number, centre, i[0], i is lead, best is None
            gone = {i[0] for i in (lead, *members)}
            left = [i for i in left if i[0] not in gone]
            number += 1


def packed_windows(items: DataFrame, keys: list[str], usable: float, quantum: float, guard: float) -> DataFrame:
    """keys and ``WINDOWS`` of each receiver's items (``ITEM``; ranks differ within a receiver)."""
    return carried(items, keys, ITEM, WindowFold(usable, quantum, guard), WINDOWS, ["rank"])


#: Columns that ``PublisherFold`` takes and what it gives: a version's ranking.
SCORE = ["t_us", "subject", "score"]
PUBLISHED = "version long, t_us long, rank int, subject long, score double"


class PublisherFold:
    """A ranking of the newest scores, looked at no more often than ``every`` and given only when it has changed.

    Rows: t_us, subject, score (null: the subject is gone). Changed means other subjects, another order, or a score that
    moved by ``moved`` or more. The state is the subjects' newest scores, by their names as texts, and the ranking given last,
    ``most`` long; a row replaces one score, and only a look goes through them all.
    """

    def __init__(self, every: int, most: int = 10, moved: float = 0.0):
        self.every, self.most, self.moved = every, most, moved

    def start(self) -> dict:
        return {"scores": {}, "run": None, "given": None, "version": 0}

    def _look(self, state: dict, t: int) -> list[tuple]:
        state["run"] = t
        top = heapq.nsmallest(self.most, state["scores"].values(), key=lambda s: (-s[1], s[0]))
        given = state["given"]
        if given is not None and [s for s, _ in top] == [s for s, _ in given] and all(abs(a - b) < self.moved or a == b for (_, a), (_, b) in zip(top, given, strict=True)):
            return []
        state["version"] += 1
        state["given"] = [list(s) for s in top]
        return [(state["version"], t, k + 1, s, x) for k, (s, x) in enumerate(top)]

    def step(self, state: dict, row: tuple) -> list[tuple]:
        t, subject, score = row
        out = self._look(state, state["run"] + self.every) if state["run"] is not None and t - state["run"] >= self.every else []
        if score is None:
            state["scores"].pop(str(subject), None)
        else:
            state["scores"][str(subject)] = [subject, score]
        return out + (self._look(state, t) if state["run"] is None or t - state["run"] >= self.every else [])

    def end(self, state: dict) -> tuple:
        return ()


def published(scores: DataFrame, keys: list[str], every: int, most: int = 10, moved: float = 0.0) -> DataFrame:
    """keys and ``PUBLISHED`` of each site's scores (``SCORE``)."""
    return carried(scores, keys, SCORE, PublisherFold(every, most, moved), PUBLISHED)


def page_after(rows: DataFrame, order: list[str], after: tuple | None, most: int) -> DataFrame:
    """At most ``most`` rows that come after the key ``after`` (the first, if null) in ascending order of ``order``, whose values are never null.

    The key is a filter, which the scan can use, so a late page reads no more than an early one and rows that are added
    or dropped before it don't move it.
    """
    later = F.lit(True)
    if after is not None:
        later = F.lit(False)
        for column, value in reversed(list(zip(order, after, strict=True))):
            later = (F.col(column) > F.lit(value)) | ((F.col(column) == F.lit(value)) & later)
        later = later & (F.col(order[0]) >= F.lit(after[0]))
    return rows.where(later).orderBy(*order).limit(most)


def last_key(page: DataFrame, order: list[str]) -> tuple | None:
    """The cursor behind a page: the key of its last row; null behind an empty one."""
    last = page.agg(F.max(F.struct(*order)).alias("k")).first()["k"]
    return None if last is None else tuple(last)
