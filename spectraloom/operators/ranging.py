"""Ranging codes of positioning satellites and the search for them in sample blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.functions.gamma import floor_threshold

# Fixed values of the public signal specification: chips a second, chips of a code, feedback taps of both registers, and
# the pair of taps of the second register that makes each satellite's code, from number 1 on.
CHIP_RATE, CHIPS = 1_023_000, 1023
FEEDBACK = ((3, 10), (2, 3, 6, 8, 9, 10))
CODE_TAPS = (
    (2, 6), (3, 7), (4, 8), (5, 9), (1, 9), (2, 10), (1, 8), (2, 9), (3, 10), (2, 3), (3, 4), (5, 6), (6, 7), (7, 8), (8, 9), (9, 10),
    (1, 4), (2, 5), (3, 6), (4, 7), (5, 8), (6, 9), (1, 3), (4, 6), (5, 7), (6, 8), (7, 9), (8, 10), (1, 6), (2, 7), (3, 8), (4, 9),
)


def register(feedback: tuple[int, ...], taps: tuple[int, ...]) -> np.ndarray:
    """One period of a ten-stage register that starts with ones: the sum of ``taps`` before each shift."""
    stages, out = [1] * 10, []
    for _ in range(CHIPS):
        out.append(sum(stages[t - 1] for t in taps) % 2)
        stages = [sum(stages[t - 1] for t in feedback) % 2, *stages[:-1]]
    return np.array(out)


def ranging_code(satellite: int) -> np.ndarray:
    """The 1,023 chips, 0 or 1, of a satellite's code."""
    return register(FEEDBACK[0], (10,)) ^ register(FEEDBACK[1], CODE_TAPS[satellite - 1])


def noise_bar(cells: int, blocks: int, false_alarm: float) -> float:
    """The ratio of peak to mean that noise, summed over ``blocks``, passes in one of ``cells`` with the given probability."""
    return float(floor_threshold(blocks, false_alarm / cells)[0])


def _search(rate: int, satellites: list[int], shifts: list[float], blocks: int):
    n, guard = rate // 1000, -(-rate // CHIP_RATE)
    at = np.arange(n) * CHIP_RATE // rate % CHIPS
    codes = {s: np.conj(np.fft.fft(1 - 2.0 * ranging_code(s)[at])) for s in satellites}
    turns = np.exp(-2j * np.pi * np.array(shifts)[:, None] * np.arange(n * blocks) / rate)

    def one(x: np.ndarray) -> list[dict]:
        spectra = np.fft.fft((x * turns).reshape(len(shifts), blocks, n))
        out = []
        for satellite in satellites:
            power = (np.abs(np.fft.ifft(spectra * codes[satellite])) ** 2).sum(axis=1)
            top = power.argmax(axis=1)
            away = np.abs((np.arange(n) - top[:, None] + n // 2) % n - n // 2) > guard
            mean = (power * away).sum(axis=1) / away.sum(axis=1)
            ratio = np.divide(power.max(axis=1), mean, out=np.zeros(len(shifts)), where=mean > 0)
            best = int(ratio.argmax())
            out.append({"satellite": satellite, "phase": float(top[best] * CHIP_RATE / rate), "shift": shifts[best], "ratio": float(ratio[best])})
        return out

    nothing = [{"satellite": s, "phase": None, "shift": None, "ratio": None} for s in satellites]

    @F.pandas_udf("array<struct<satellite: int, phase: double, shift: double, ratio: double>>")
    def run(i: pd.Series, q: pd.Series) -> pd.Series:
        out = []
        for re, im in zip(i, q):
            short = re is None or im is None or min(len(re), len(im)) < n * blocks
            out.append(nothing if short else one(np.asarray(re[: n * blocks], float) + 1j * np.asarray(im[: n * blocks], float)))
        return pd.Series(out)

    return run


def acquire(samples: DataFrame, row: str, i: str, q: str, rate: int, satellites: list[int], shifts: list[float], blocks: int = 4, false_alarm: float = 1e-4) -> DataFrame:
    """row, satellite, phase (chips), shift (Hz), ratio, found: where each code lies in the first ``blocks`` milliseconds of each row.

    Circular correlations of a millisecond each, their powers summed; ``ratio`` is the peak over the mean of what lies more
    than a chip away, at its best shift, and must reach the bar that noise passes with probability ``false_alarm``. A row's
    samples are sent once and their spectra made once for all satellites. Null or shorter samples give nulls and are not
    found; silence has the ratio 0. ``rate`` is a multiple of 1,000.
    """
    bar = noise_bar(rate // 1000 * len(shifts), blocks, false_alarm)
    found = samples.select(row, F.explode(_search(rate, satellites, shifts, blocks)(i, q)).alias("__r"))
    return found.select(row, "__r.*").withColumn("found", F.coalesce(F.col("ratio") >= bar, F.lit(False)))
