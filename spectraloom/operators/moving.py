"""The site of a moving device: fixes folded into known sites, ``mobile`` and ``unassigned``."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

from spectraloom.operators.carried import carried

EARTH_KM = 6371.0088
#: Columns that the fold takes; a row without a position is a tick without a fix.
FIX = ["t_us", "lat", "lon", "speed"]
#: What it gives for every row: the device's kind of place, the site's number (from 1) and whether this row founded it.
SITES = "t_us long, place string, site int, founded boolean"


@dataclass(frozen=True)
class SiteRules:
    """Fixed values, in seconds, metres and metres a second."""

    radius_m: float = 200.0
    mobile_speed: float = 5.0
    mobile_window_s: float = 300.0
    still_s: float = 60.0
    drift_s: float = 30.0
    hold_s: float = 3600.0


def distance_m(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    """Along a great circle."""
    a, b = math.radians(lat1), math.radians(lat2)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(lon2 - lon1) / 2) ** 2
    return 2000 * EARTH_KM * math.asin(min(1.0, math.sqrt(h)))


class SiteFold:
    """A fast or spread-out device is mobile; one that has been still joins the nearest site in reach of its fixes' mean or founds one.

    Speed is what the fix says, else the way from the window's first fix to the last over their time. Without fixes the site is
    held for a time after the last fix in it. The state is the fixes of the window and the device's sites.
    """

    def __init__(self, rules: SiteRules | None = None):
        self.rules = rules or SiteRules()

    def start(self) -> dict:
        return {"fixes": [], "sites": [], "place": "unassigned", "site": None, "seen": None}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        t, lat, lon, speed = row
        founded = False
        if lat is None or lon is None:
            if state["site"] is not None and t - state["seen"] > self.rules.hold_s * 1e6:
                state["place"], state["site"] = "unassigned", None
            elif state["place"] == "mobile" and state["fixes"] and t - state["fixes"][-1][0] > self.rules.hold_s * 1e6:
                state["place"] = "unassigned"
        else:
            window = self.rules.mobile_window_s * 1e6
            state["fixes"] = [f for f in state["fixes"] if t - f[0] <= window] + [[t, lat, lon]]
            founded = self._fixed(state, speed)
        return [(t, state["place"], state["site"], founded)]

    def _fixed(self, state: dict, speed: float | None) -> bool:
        rules, fixes = self.rules, state["fixes"]
        (t0, *first), (t, *last) = fixes[0], fixes[-1]
        seconds = (t - t0) / 1e6
        if speed is None and seconds >= rules.drift_s:
            speed = distance_m(*first, *last) / seconds
        mean = [sum(f[k] for f in fixes) / len(fixes) for k in (1, 2)]
        spread = 2 * max(distance_m(*mean, *f[1:]) for f in fixes)
        if (speed or 0.0) > rules.mobile_speed or spread > rules.radius_m:
            state["place"], state["site"] = "mobile", None
            return False
        if seconds < min(rules.still_s, rules.mobile_window_s):
            if state["site"] is not None and distance_m(*mean, *state["sites"][state["site"] - 1]) <= rules.radius_m:
                state["seen"] = t
            return False
        near = [(distance_m(*mean, *s), k) for k, s in enumerate(state["sites"])]
        founded = not near or min(near)[0] > rules.radius_m
        if founded:
            state["sites"].append(mean)
        state["place"], state["site"], state["seen"] = "site", len(state["sites"]) if founded else min(near)[1] + 1, t
        return founded

    def end(self, state: dict) -> tuple:
        return ()


def assigned_sites(fixes: DataFrame, keys: list[str], rules: SiteRules | None = None) -> DataFrame:
    """keys and ``SITES`` of each device's fixes (``FIX``)."""
    return carried(fixes, keys, FIX, SiteFold(rules), SITES)
