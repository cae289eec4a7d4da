"""Bursts linked into tracks, and tracks that hop from one to the next into hop sets.

A detection is a box of time and frequency. Detections of one receiver are taken in the order of their ends and go to the nearest
open track whose centre and width they fit; what fits none opens a track of its own, which counts once it has enough bursts. Tracks
that have come together merge, a track whose bursts have fallen into two groups splits, and a track closes when it has been
silent for too long in observed time, that is without the time the receiver was away.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import fmean, pstdev

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.graph import connected_components

#: Columns that a tracker takes, in this order; a row without a centre says that the receiver was away from start to end.
DETECTION = ["end_us", "start_us", "detection", "centre", "width"]
#: What it tells: link (detection, n: the burst's number), open, merge and split (other: the older track), hop (other: the
#: track that the burst came from), close (n bursts, on_us time on air, mean_gap_us between starts, duty).
EVENTS = "track long, event string, at_us long, detection long, other long, n long, on_us long, mean_gap_us double, duty double"
#: Places in a burst.
START, END, CENTRE, WIDTH = range(4)


@dataclass(frozen=True)
class TrackRules:
    """Fixed values of the association, in bins and microseconds."""

    bin: float = 1.0
    gate_bins: float = 2.0
    gate_share: float = 0.1
    width_ratio: float = 2.0
    idle_us: int = 60_000_000
    idle_intervals: float = 4.0
    longest_idle_us: int = 3_600_000_000
    confirm_bursts: int = 2
    confirm_on_us: int = 100_000
    merge_gates: float = 0.5
    merge_ratio: float = 1.25
    kept: int = 16
    split_least: int = 5
    split_gates: float = 0.6
    split_sigma: float = 4.0
    hop_us: int = 20_000
    hop_share: float = 0.25
    hop_ratio: float = 1.5
    most_open: int = 4096


class BurstTracker:
    """The fold of one receiver's detections; see ``EVENTS`` for its results."""

    def __init__(self, rules: TrackRules | None = None):
        self.rules = rules or TrackRules()

    def start(self) -> dict:
        return {"next": 1, "away": 0, "tracks": []}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        end, start, detection, centre, width = row
        if centre is None:
            state["away"] += max(0, end - start)
            return []
        out: list[tuple] = []
        self._expire(state, end, out)
        burst = [start, end, centre, max(width or 0.0, self.rules.gate_bins * self.rules.bin)]
        track = self._nearest(state["tracks"], burst)
        if track is None:
            track = self._opened(state, burst)
            if len(state["tracks"]) > self.rules.most_open:
                self._close(state, min(state["tracks"], key=lambda t: (t["last"], t["id"])), out)
        elif start <= track["bursts"][-1][END]:
            last = track["bursts"][-1]
            track["on"] += max(0, end - last[END])
            last[END] = max(last[END], end)
        else:
            self._finish(state, track, out)
            track = self._own(state, track, burst)
            self._begin(track, burst)
        track["last"] = max(track["last"], end)
        track["away"] = state["away"]
        self._link(track, detection, start, out)
        self._confirm(track, out)
        self._merge(state, track, out)
        return out

    def end(self, state: dict) -> list[tuple]:
        out: list[tuple] = []
        for track in sorted(state["tracks"], key=lambda t: t["id"]):
            self._close(state, track, out)
        return out

    def _opened(self, state: dict, burst: list) -> dict:
        track = {"id": state["next"], "n": 1, "on": burst[END] - burst[START], "first": burst[START], "last": burst[END], "gaps": 0, "away": state["away"], "away0": state["away"], "bursts": [burst], "shape": None, "open": False, "links": [], "kin": []}
        state["next"] += 1
        state["tracks"].append(track)
        return track

    def _begin(self, track: dict, burst: list) -> None:
        track["gaps"] += burst[START] - track["bursts"][-1][START]
        track["n"] += 1
        track["on"] += burst[END] - burst[START]
        track["bursts"] = [*track["bursts"], burst][-self.rules.kept :]
        track["shape"] = None

    def _link(self, track: dict, detection: int, at: int, out: list) -> None:
        row = (track["id"], "link", at, detection, None, track["n"], None, None, None)
        if track["open"]:
            out.append(row)
        else:
            track["links"].append(row)

    def _confirm(self, track: dict, out: list, hopped: bool = False) -> None:
        if not track["open"] and (hopped or track["n"] >= self.rules.confirm_bursts or track["on"] >= self.rules.confirm_on_us):
            track["open"] = True
            out.append((track["id"], "open", track["first"], None, None, track["n"], None, None, None))
            out.extend(tuple(x) for x in track["links"])
            track["links"] = []

    @staticmethod
    def _shape(track: dict) -> list[float]:
        """Mean centre and width of the bursts kept, worked out once for each change of them."""
        if track["shape"] is None:
            track["shape"] = [fmean([b[CENTRE] for b in track["bursts"]]), fmean([b[WIDTH] for b in track["bursts"]])]
        return track["shape"]

    def _gate(self, width: float) -> float:
        return max(self.rules.gate_bins * self.rules.bin, self.rules.gate_share * width)

    def _nearest(self, tracks: list[dict], burst: list) -> dict | None:
        best = None
        for track in tracks:
            centre, width = track["shape"] or self._shape(track)
            narrow, wide = (width, burst[WIDTH]) if width <= burst[WIDTH] else (burst[WIDTH], width)
            apart, ratio = abs(centre - burst[CENTRE]), wide / narrow
            if ratio > self.rules.width_ratio:
                continue
            gate = self._gate(wide)
            if apart <= gate or apart <= narrow / 2:  # within the gate, or each centre lies within the other
                cost = (apart / gate + math.log2(ratio), track["id"])
                if best is None or cost < best[0]:
                    best = (cost, track)
        return best and best[1]

    def _patience(self, track: dict) -> float:
        mean = track["gaps"] / (track["n"] - 1) if track["n"] > 1 else 0
        return max(self.rules.idle_us, min(self.rules.idle_intervals * mean, self.rules.longest_idle_us))

    def _expire(self, state: dict, now: int, out: list) -> None:
        for track in sorted(state["tracks"], key=lambda t: t["id"]):
            silent = now - track["last"] - (state["away"] - track["away"])
            if silent > self._patience(track):
                self._close(state, track, out)

    def _close(self, state: dict, track: dict, out: list) -> None:
        self._finish(state, track, out)
        state["tracks"].remove(track)
        for other in state["tracks"]:
            if track["id"] in other["kin"]:
                other["kin"].remove(track["id"])
        if track["open"]:  # what never was confirmed is dropped with its links
            seen = track["last"] - track["first"] - (track["away"] - track["away0"])
            gap = track["gaps"] / (track["n"] - 1) if track["n"] > 1 else None
            out.append((track["id"], "close", track["last"], None, None, track["n"], track["on"], gap, min(1.0, track["on"] / seen) if seen > 0 else 1.0))

    def _finish(self, state: dict, track: dict, out: list) -> None:
        """A burst has its whole length now: where did it hop from, and do the bursts still belong together?"""
        burst, rules = track["bursts"][-1], self.rules
        dwell, best = burst[END] - burst[START], None
        reach, start = max(rules.hop_us, rules.hop_share * dwell), burst[START]
        for other in state["tracks"]:
            centre, width = other["shape"] or self._shape(other)
            if other is track or abs(centre - burst[CENTRE]) < (width + burst[WIDTH]) / 2 or max(width, burst[WIDTH]) > rules.hop_ratio * min(width, burst[WIDTH]):
                continue
            for b in other["bursts"]:
                away = abs(start - b[END])
                if away > reach:
                    continue
                stay = b[END] - b[START]
                if max(stay, dwell) <= rules.hop_ratio * min(stay, dwell) and (best is None or (away, other["id"]) < best[0]):
                    best = ((away, other["id"]), other)
        if best:
            for one in (best[1], track):
                self._confirm(one, out, hopped=True)
            out.append((track["id"], "hop", burst[START], None, best[1]["id"], track["n"], None, None, None))
        self._split(state, track, out)

    def _split(self, state: dict, track: dict, out: list) -> None:
        rules, bursts = self.rules, track["bursts"]
        if len(bursts) < rules.kept:
            return
        by = sorted(range(len(bursts)), key=lambda k: (bursts[k][CENTRE], k))
        steps = [bursts[b][CENTRE] - bursts[a][CENTRE] for a, b in zip(by, by[1:], strict=False)]
        cut = max(range(rules.split_least - 1, len(by) - rules.split_least), key=lambda k: (steps[k], -k))
        low, high = sorted(by[: cut + 1]), sorted(by[cut + 1 :])
        centres = [[bursts[k][CENTRE] for k in g] for g in (low, high)]
        spread = math.sqrt(fmean([pstdev(c) ** 2 for c in centres]))
        apart = fmean(centres[1]) - fmean(centres[0])
        half = len(bursts) // 2
        both = all(g[0] < half <= g[-1] for g in (low, high))  # neither has just begun or ended
        if not both or apart < rules.split_gates * self._gate(self._shape(track)[1]) or apart < rules.split_sigma * spread:
            return
        less, more = sorted((low, high), key=len)
        gone = [bursts[k] for k in less]
        new = self._opened(state, gone[0])
        new |= {"n": len(gone), "on": sum(b[END] - b[START] for b in gone), "first": gone[0][START], "last": gone[-1][END], "gaps": gone[-1][START] - gone[0][START], "bursts": gone, "shape": None, "open": True, "kin": [track["id"], *track["kin"]]}
        track["bursts"] = [bursts[k] for k in more]
        track["shape"] = None
        track["n"] -= len(gone)
        track["on"] -= new["on"]
        track["last"] = max(b[END] for b in track["bursts"])
        out.append((new["id"], "split", gone[0][START], None, track["id"], new["n"], None, None, None))

    def _own(self, state: dict, track: dict, burst: list) -> dict:
        """The track that a new burst belongs to after what finishing the one before may have split."""
        return self._nearest(state["tracks"], burst) or track

    def _merge(self, state: dict, track: dict, out: list) -> None:
        centre, width = self._shape(track)
        for other in sorted(state["tracks"], key=lambda t: t["id"]):
            c, w = other["shape"] or self._shape(other)
            if other is track or abs(c - centre) > self.rules.merge_gates * self._gate(max(w, width)) or max(w, width) > self.rules.merge_ratio * min(w, width):
                continue
            kin = other["id"] in track["kin"] or track["id"] in other["kin"]
            if kin or any(a[START] <= b[END] and b[START] <= a[END] for a in track["bursts"] for b in other["bursts"]):
                continue
            old, young = sorted((track, other), key=lambda t: (not t["open"], t["id"]))
            state["tracks"].remove(young)
            first, last = sorted((old, young), key=lambda t: t["bursts"][-1][START])
            old["bursts"] = sorted([*old["bursts"], *young["bursts"]])[-self.rules.kept :]
            old["shape"] = None
            old["gaps"] = max(old["first"] + old["gaps"], young["first"] + young["gaps"]) - min(old["first"], young["first"])
            old |= {"n": old["n"] + young["n"], "on": old["on"] + young["on"], "away": last["away"], "away0": min(old["away0"], young["away0"])}
            old |= {"first": min(old["first"], young["first"]), "last": max(old["last"], young["last"]), "kin": [*old["kin"], *young["kin"]]}
            if young["open"]:
                out.append((young["id"], "merge", young["last"], None, old["id"], young["n"], None, None, None))
            else:
                old["links"] += [[old["id"], *x[1:]] for x in young["links"]]
            if old["open"]:
                out.extend(tuple(x) for x in old["links"])
                old["links"] = []
            self._confirm(old, out)
            return


def tracks(detections: DataFrame, keys: list[str], rules: TrackRules | None = None) -> DataFrame:
    """keys and ``EVENTS`` of each receiver's detections (``DETECTION``)."""
    from spectraloom.operators.carried import carried

    return carried(detections, keys, DETECTION, BurstTracker(rules), EVENTS)


def survivors(events: DataFrame, keys: list[str]) -> DataFrame:
    """keys, track, into: each track that went into another one, and the track it is part of in the end."""
    from spectraloom.operators.joins import follow_merges

    named = lambda c: F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys], c)
    merged = events.where("event = 'merge'").select(named("track").alias("id"), named("other").alias("into"))
    ends = follow_merges(merged, "id", "into")
    return events.where("event = 'merge'").select(*keys, "track", named("track").alias("id")).join(ends, "id").select(*keys, "track", F.element_at(F.split("root", ":"), -1).cast("long").alias("into"))


def hop_sets(events: DataFrame, keys: list[str], links: int = 2, channels: int = 3, hops: int = 10) -> DataFrame:
    """keys, hop_set (its lowest track), track, n_links, n_hops: tracks that hop to and from each other often enough.

    A track counts with ``links`` hops of its own at least, a set with ``channels`` tracks and ``hops`` hops.
    """
    hop = events.where("event = 'hop'").select(*keys, F.col("track").alias("t"), F.col("other").alias("o"))
    ends = hop.select(*keys, "t").unionByName(hop.select(*keys, F.col("o").alias("t")))
    counted = ends.groupBy(*keys, "t").agg(F.count("*").alias("n_links")).where(F.col("n_links") >= links)
    name = F.xxhash64(*keys, "t")
    held = counted.select(*keys, "t", "n_links", name.alias("node"))
    both = hop.join(held.select(*keys, "t", F.col("node").alias("a")), [*keys, "t"]).join(held.select(*keys, F.col("t").alias("o"), F.col("node").alias("b")), [*keys, "o"])
    root = connected_components(both.select("a", "b"))
    members = held.join(root, "node").select(*keys, "t", "n_links", "root")
    sets = members.groupBy(*keys, "root").agg(F.count("*").alias("n"), F.min("t").alias("hop_set"))
    inner = both.join(root, F.col("a") == F.col("node")).groupBy("root").agg(F.count("*").alias("n_hops"))
    whole = sets.join(inner, "root").where((F.col("n") >= channels) & (F.col("n_hops") >= hops))
    return members.join(whole, [*keys, "root"]).select(*keys, "hop_set", F.col("t").alias("track"), "n_links", "n_hops")


def receiver_detections(visits: DataFrame) -> DataFrame:
    """Visits as detections of their channel's receiver; an ``error`` says that it was away."""
    away = F.col("tier") == "error"
    return visits.select(
        "channel",
        "end_us",
        "start_us",
        F.col("event_id").alias("detection"),
        F.when(~away, F.col("cell").cast("double")).alias("centre"),
        F.when(~away, 2.0 + F.floor(F.col("level") / 64)).cast("double").alias("width"),
    )

