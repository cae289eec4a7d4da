"""Blind estimates on arrays, one row at a time in Arrow batches: levels of symbols, run lengths, carriers, combs of lines."""

from __future__ import annotations

from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

#: A level fit with this quality or more counts as locked. Fixed value.
LOCKED = 0.3


def _values(x) -> np.ndarray:
    x = np.asarray([] if x is None else x, dtype=float)
    return x[np.isfinite(x)]


def fit_levels(x: np.ndarray, levels: int, rounds: int = 60) -> tuple[float, float, float]:
    """Lowest level, spacing and spread of equally spaced levels with noise of one size: a mixture of normals fitted by expectation and maximisation.

    Each symbol belongs to every level by its likelihood; the levels' line is the weighted regression of symbols on level numbers.
    """
    if not len(x) or np.ptp(x) == 0:
        return (float(x.mean()) if len(x) else 0.0), 0.0, 0.0
    k = np.arange(levels)
    low, step = float(x.min()), float(np.ptp(x)) / (levels - 1)
    spread = step / 4
    for _ in range(rounds):
        far = (x[:, None] - low - step * k) ** 2
        share = np.exp((far.min(axis=1, keepdims=True) - far) / (2 * spread * spread))
        share /= share.sum(axis=1, keepdims=True)
        weight = share.sum(axis=0)
        middle = (weight * k).sum() / len(x)
        bend = (weight * (k - middle) ** 2).sum()
        if bend < 1e-12 * len(x):
            break
        moved = float((share * (k - middle)).sum(axis=1) @ x) / bend
        if moved <= 0:
            break
        low, before, step = float(x.mean()) - moved * middle, step, moved
        spread = max(float(np.sqrt((share * (x[:, None] - low - step * k) ** 2).sum() / len(x))), 1e-9 * step)
        if abs(step - before) <= 1e-12 * step:
            break
    left = x - low - step * np.clip(np.rint((x - low) / step), 0, levels - 1)
    return low, step, float(np.sqrt((left * left).mean()))


def slice_levels(levels: int, labels: list[int] | None = None, invert: bool = False):
    """A pandas UDF: soft symbols to struct(bits, spacing, centre, quality, locked), each symbol's label from its highest bit.

    ``labels`` gives the label of each level from the lowest; without it labels are Gray-coded. A symbol that isn't finite
    counts as 0. Rows of fewer than 16 symbols a level are sliced but never locked; a flat row has quality 0.
    """
    width = (levels - 1).bit_length()
    names = labels or [i ^ i >> 1 for i in range(levels)]
    bits_of = np.array([[n >> b & 1 for b in range(width - 1, -1, -1)] for n in (names[::-1] if invert else names)])

    def one(raw) -> tuple:
        if raw is None:
            return None, None, None, None, None
        x = np.nan_to_num(np.asarray(raw, dtype=float), nan=0.0, posinf=0.0, neginf=0.0)
        low, step, sigma = fit_levels(x, levels)
        at = np.clip(np.ceil((x - low) / step - 0.5), 0, levels - 1).astype(int) if step > 0 else np.zeros(len(x), int)
        quality = min(1.0, max(0.0, 1 - 4 * sigma / step)) if step > 0 else 0.0
        return bits_of[at].ravel().tolist(), step, low + step * (levels - 1) / 2, quality, bool(quality >= LOCKED and len(x) >= 16 * levels)

    @F.pandas_udf("bits array<int>, spacing double, centre double, quality double, locked boolean")
    def sliced(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows], columns=["bits", "spacing", "centre", "quality", "locked"])

    return sliced


def crossings(x: np.ndarray, threshold: float) -> np.ndarray:
    """Where a series crosses the threshold, between samples by a straight line."""
    up = x > threshold
    k = np.flatnonzero(up[1:] != up[:-1])
    return k + (threshold - x[k]) / (x[k + 1] - x[k])


def lattice_rate(at: np.ndarray, fastest: float, fine: int = 8) -> float | None:
    """How many lattice points a unit of time the times ``at`` lie on, up to ``fastest``.

    Times on a lattice are all in phase at its rate and its multiples, and nowhere below it: the lowest peak of their spectrum
    that is nearly as high as the highest is the rate. None for fewer than nine times.
    """
    if len(at) < 9 or np.ptp(at) == 0:
        return None
    bins = np.bincount(np.rint((at - at[0]) * fine * fastest).astype(np.int64))
    n = 1 << (4 * len(bins) - 1).bit_length()
    power = np.abs(np.fft.rfft(bins, n))
    rates = np.arange(len(power)) * fine * fastest / n
    lowest = max(4 / np.ptp(at), 0.6 / float(np.quantile(np.diff(at), 0.25)))  # a unit isn't longer than the short runs
    inner = np.flatnonzero((rates >= lowest) & (rates <= 1.02 * fastest))
    inner = inner[(inner > 0) & (inner < len(power) - 1)]
    if not len(inner):
        return None
    k = inner[np.argmax(power[inner] >= 0.8 * power[inner].max())]
    while k + 1 < len(power) - 1 and power[k + 1] > power[k]:
        k += 1
    a, b, c = power[k - 1 : k + 2]
    bend = a - 2 * b + c
    return float((k + (0.5 * (a - c) / bend if bend else 0.0)) * fine * fastest / n)


def unit_rate(rate: float, threshold: float, fastest: float):
    """A pandas UDF: symbols a second of a two-level waveform from its crossings; null with fewer than 8 runs of usable length."""

    def one(raw):
        at = crossings(_values(raw), threshold)
        if len(at) < 2:
            return None
        return lattice_rate(at[np.concatenate([[True], np.diff(at) > 0.4 * rate / fastest])] / rate, fastest)

    @F.pandas_udf("double")
    def found(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return found


def carriers(rate: float, lowest: float, least_db: float, most: int, apart: int = 8):
    """A pandas UDF: real samples to array<struct(hz, snr_db)>, the strongest carriers first, at least ``apart`` bins apart.

    The spectrum is that of the longest power of two of samples; rows under 1,024 samples or silent ones have none.
    """

    def one(raw) -> list:
        x = np.asarray([] if raw is None else raw, dtype=float)
        n = 1 << max(len(x).bit_length() - 1, 0)
        if n < 1024:
            return []
        p = np.abs(np.fft.rfft(x[:n] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)))) ** 2
        lo, hi = max(ceil(max(lowest, 0) * n / rate), 2), n // 2 - 2
        noise = float(np.sort(p[lo:hi])[(hi - lo) // 2]) if hi > lo + 2 else 0.0
        if not noise > 0:
            return []
        k = np.arange(lo, hi)
        k = k[(p[k] > noise * 10 ** (least_db / 10)) & (p[k] > p[k - 1]) & (p[k] >= p[k + 1])]
        picked: list[int] = []
        for c in k[np.argsort(-p[k], kind="stable")]:
            if len(picked) < most and all(abs(int(c) - q) >= apart for q in picked):
                picked.append(int(c))
        out = []
        for c in picked:
            a, b, d = np.log(np.maximum(p[c - 1 : c + 2], 1e-300))
            bend = a - 2 * b + d
            out.append({"hz": float((c + (0.5 * (a - d) / bend if bend else 0.0)) * rate / n), "snr_db": float(10 * np.log10(p[c] / noise))})
        return out

    @F.pandas_udf("array<struct<hz:double,snr_db:double>>")
    def found(rows: pd.Series) -> pd.Series:
        return rows.map(one)

    return found


def track_carrier(rate: float, hz: float, block: int):
    """A function of columns (samples, absolute index of the first; null: 0) to array<struct(t_s, amplitude, phase)>, a point a whole block, the phase unwrapped."""

    def one(raw, start) -> list:
        x = np.asarray([] if raw is None else raw, dtype=float)
        n = len(x) // block if block > 0 else 0
        at = np.arange(n * block) + int(start)
        mean = (x[: n * block] * np.exp(-2j * np.pi * ((at * hz / rate) % 1.0))).reshape(n, block).mean(axis=1) if n else np.zeros(0)
        return [{"t_s": float(t), "amplitude": float(2 * abs(z)), "phase": float(f)} for t, z, f in zip(at[::block] / rate if n else [], mean, np.unwrap(np.angle(mean)))]

    @F.pandas_udf("array<struct<t_s:double,amplitude:double,phase:double>>")
    def tracked(rows: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([one(x, s) for x, s in zip(rows, starts)], dtype=object)

    return lambda samples, start: tracked(F.col(samples), F.coalesce(F.col(start), F.lit(0)))


def tails(n: int, p: np.ndarray) -> np.ndarray:
    """For each chance ``p`` a row of the logarithms of the chances of k successes or more in ``n`` trials, k from 0 to n."""
    k = np.arange(n + 1)
    ways = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, n + 1)))])
    each = ways[n] - ways[k] - ways[n - k] + k * np.log(p)[:, None] + (n - k) * np.log1p(-p)[:, None]
    return np.logaddexp.accumulate(each[:, ::-1], axis=1)[:, ::-1]


def best_grid(f: np.ndarray, span: float, near: float, least: float, widest: float) -> tuple[np.ndarray, float, float]:
    """Which sorted lines lie on the grid that is least likely by chance, its spacing, and the logarithm of that chance.

    Spacings are tried so finely that no line drifts by more than half of ``near`` over all lines. Folded by a spacing, lines are
    points on a circle; the members are the most that fit into an arc of twice ``near`` (one sorted pass finds them), and by
    chance the others fall into a member's arc with the share that the arc has of the circle. Every line could be the
    member and every spacing that can be told apart could be the grid's: so many chances there are.
    """
    n, reach = len(f), float(np.ptp(f)) or 1.0
    first, last = 1 / widest, 1 / least
    rates = [first]
    while rates[-1] < last:  # of u: half of near, in periods, over the reach
        rates.append(rates[-1] * (1 + near / (2 * reach)))
    u = np.array(rates[:-1])
    best = (np.inf, 0, np.zeros(n, bool))
    cells = max(1.0, span / near * np.log(last / first)) * n
    for at in range(0, len(u), 4096):
        part = u[at : at + 4096, None]
        turn = (f[None, :] * part) % 1.0
        order = np.argsort(turn, axis=1)
        ring = np.take_along_axis(turn, order, axis=1)
        arc = np.minimum(2 * near * part, 1.0)
        wide = np.concatenate([ring, ring + 1], axis=1)
        count = np.zeros((len(part), n), np.int64)
        for j in range(1, n + 1):  # how many follow within the arc: nested, so counted step by step
            inside = wide[:, j : j + n] - ring <= arc if j < n else np.zeros((len(part), n), bool)
            count += inside
            if not inside.any():
                break
        most = count.max(axis=1) + 1
        tried = np.arange(len(part))
        if most.max() > 1:  # of equally many members the finest arc is the least likely, and arcs grow
            tried = np.sort(np.unique(most, return_index=True)[1])
        chances = tails(n - 1, np.clip(arc[tried, 0], 1e-300, 1 - 1e-12))[np.arange(len(tried)), most[tried] - 1]
        k, chance = int(tried[np.argmin(chances)]), float(chances.min())
        if chance < best[0]:
            start = int(count[k].argmax())
            held = np.zeros(n, bool)
            held[order[k][(start + np.arange(most[k])) % n]] = True
            best = (chance, at + k, held)
    _, k, held = best
    step = 1 / float(u[k])
    on = f[held]
    index = np.rint((on - on[0]) / step)
    if len(on) >= 3 and np.ptp(index):
        step, offset = np.polyfit(index, on, 1)
        held = np.abs(f - offset - step * np.rint((f - offset) / step)) <= near
    arc = min(2 * near / step, 1 - 1e-12)
    return held, float(step), min(0.0, float(tails(n - 1, np.array([arc]))[0, max(int(held.sum()) - 1, 0)]) + float(np.log(cells)))


def combs(lo: float, hi: float, near: float = 1500.0, least: float = 1e5, widest: float = 2e6, members: int = 6, chance: float = 0.05):
    """A pandas UDF: line frequencies of a frame to struct(members, spacing, chance, flagged).

    ``chance`` bounds, over all grids that could be told apart, how likely uniform lines in [lo, hi] would hold such a grid.
    Fewer than three lines hold no grid; below ``members`` no chance is given.
    """

    def one(raw) -> tuple:
        f = np.sort(_values(raw))
        if len(f) < 3:
            return 0, None, None, False
        held, step, log_chance = best_grid(f, hi - lo, near, least, widest)
        n = int(held.sum())
        p = float(np.exp(log_chance)) if n >= members else None
        return n, step, p, p is not None and p < chance

    @F.pandas_udf("members int, spacing double, chance double, flagged boolean")
    def found(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(r) for r in rows], columns=["members", "spacing", "chance", "flagged"])

    return found
