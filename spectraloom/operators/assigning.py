"""Signatures assigned to clusters one after the other, as they come."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame

from spectraloom.operators.carried import carried

#: Columns that the fold takes: fields are a value and its spread each, null where it isn't known; and what it gives.
SIGNATURE = ["t_us", "signature", "fields"]
FIELDS = "array<struct<value:double,spread:double>>"
ASSIGNED = "signature long, cluster int, distance double, founded boolean, members long"


class ClusterFold:
    """Each signature joins the nearest cluster within ``reach`` or founds one.

    The distance is the root mean square of the shared fields' differences, each in units of its tolerance and both spreads; with under
    ``shared`` fields in common there is none, and any field beyond ``veto`` rules a cluster out. A cluster's field is the mean of its members'
    values and of their squared spreads. The state is a line for each cluster of the key.
    """

    def __init__(self, tolerances: list[float], reach: float = 1.0, shared: int = 3, veto: float = 3.0):
        self.tolerances, self.reach, self.shared, self.veto = tolerances, reach, shared, veto
        self._known = (None, 0, None)  # the state that was seen last, its clusters, and their fields' means and mean squared spreads

    def start(self) -> list:
        return []

    def _distance(self, fields: list, cluster: dict) -> float | None:
        z = []
        for f, (n, total, spread), tolerance in zip(fields, cluster["fields"], self.tolerances, strict=True):
            if f is not None and n:
                z.append(abs(f[0] - total / n) / math.sqrt(tolerance**2 + f[1] ** 2 + spread / n))
        if len(z) < self.shared or max(z) > self.veto:
            return None
        return math.sqrt(math.fsum(d * d for d in z) / len(z))

    def _means(self, state: list) -> np.ndarray:
        """Means and mean squared spreads of all clusters, made anew only for a state that isn't the one of the last row."""
        seen, n, held = self._known
        if seen is not state or n != len(state):
            fresh = range(n if seen is state else 0, len(state))
            if seen is not state or len(state) > len(held):
                wider = np.full((max(64, 2 * len(state)), 2, len(self.tolerances)), np.nan)
                if seen is state:
                    wider[:n] = held[:n]
                held = wider
            self._known = (state, len(state), held)
            for k in fresh:
                self._note(state, k)
        return held[: len(state)]

    def _note(self, state: list, k: int) -> None:
        self._known[2][k] = [[total / n if n else math.nan for n, total, _ in state[k]["fields"]], [spread / n if n else math.nan for n, _, spread in state[k]["fields"]]]

    def _best(self, state: list, fields: list) -> tuple[float, int] | None:
        """The least distance within reach and its cluster: numpy looks at all, and what comes near the least is worked out as defined."""
        exact = lambda ks: [(d, k) for k in ks if (d := self._distance(fields, state[k])) is not None and d <= self.reach]
        if len(state) < 8:
            return min(exact(range(len(state))), default=None)
        means = self._means(state)
        value, spread = np.array([(math.nan, 0.0) if f is None else f for f in fields]).T
        z = np.abs(value - means[:, 0]) / np.sqrt(np.square(self.tolerances) + spread * spread + means[:, 1])
        shared = ~np.isnan(z)
        z[~shared] = 0.0
        n = shared.sum(axis=1)
        room = 1 + 1e-9
        rough = np.where((n >= self.shared) & (z.max(axis=1) <= self.veto * room), np.sqrt((z * z).sum(axis=1) / np.maximum(n, 1)), np.inf)
        least = rough.min()
        if least > self.reach * room:
            return None
        near = np.flatnonzero(rough <= least * room + 1e-12).tolist()
        found = exact(near)
        return min(found) if len(found) == len(near) else min(exact(range(len(state))), default=None)  # one lay on an edge

    def step(self, state: list, row: tuple) -> list[tuple]:
        _, signature, raw = row
        fields = []
        for f in raw or [None] * len(self.tolerances):
            value, spread = (None, None) if f is None else (f["value"], f["spread"]) if isinstance(f, dict) else tuple(f)
            fields.append(None if value is None or not math.isfinite(value) else (value, spread or 0.0))
        best = self._best(state, fields)
        if best is None:
            state.append({"members": 0, "fields": [[0, 0.0, 0.0] for _ in self.tolerances]})
        k = len(state) - 1 if best is None else best[1]
        cluster = state[k]
        cluster["members"] += 1
        for f, held in zip(fields, cluster["fields"], strict=True):
            if f is not None:
                held[0], held[1], held[2] = held[0] + 1, held[1] + f[0], held[2] + f[1] ** 2
        if self._known[0] is state and k < self._known[1]:
            self._note(state, k)
        return [(signature, k + 1, None if best is None else best[0], best is None, cluster["members"])]

    def end(self, state: list) -> tuple:
        return ()


def assigned_clusters(signatures: DataFrame, keys: list[str], tolerances: list[float], **rules) -> DataFrame:
    """keys and ``ASSIGNED`` of each key's signatures (``SIGNATURE``) in order of time."""
    return carried(signatures, keys, SIGNATURE, ClusterFold(tolerances, **rules), ASSIGNED, ["t_us", "signature"])
