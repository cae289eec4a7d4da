"""Sample-by-sample stages behind a demodulator: de-emphasis, automatic gain, squelch, and envelope and frequency-shift detection.

Each is a fold over blocks (the number of the first sample, samples, reset) that gives every block's samples anew, so a recording's result is the
same however it is cut. A block that doesn't follow the one before, says ``reset`` or is null starts the stage anew.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.carried import carried

#: What a stage gives for each block: the number of its first sample and its samples (null where a squelch is closed).
AUDIO = "at long, samples array<double>"


class Stage:
    """A fold made of a start state (a list of numbers) and one sample's step."""

    def begin(self) -> list:
        raise NotImplementedError

    def sample(self, held: list, x: float) -> float | None:
        raise NotImplementedError

    def start(self) -> dict:
        return {"next": None, "held": self.begin()}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        at, samples, reset = row
        if reset or samples is None or (state["next"] is not None and at != state["next"]):
            state["held"] = self.begin()
        samples = samples or []
        state["next"] = at + len(samples)
        held = state["held"]
        return [(at, [self.sample(held, x) for x in samples])]

    def end(self, state: dict) -> tuple:
        return ()


class Deemphasis(Stage):
    """A low pass of one pole with a time constant; it begins at the first sample's level."""

    def __init__(self, rate: float, seconds: float):
        self.share = 1 - math.exp(-1 / (rate * seconds))

    def begin(self) -> list:
        return [None]

    def sample(self, held: list, x: float) -> float:
        held[0] = x if held[0] is None else held[0] + self.share * (x - held[0])
        return held[0]


class Gain(Stage):
    """Scales to a wanted level: the level follows the magnitude fast upwards and slowly downwards, and the gain is bounded."""

    def __init__(self, rate: float, level: float = 0.5, attack_s: float = 0.005, decay_s: float = 0.5, most: float = 1000.0):
        self.level, self.most = level, most
        self.up, self.down = (1 - math.exp(-1 / (rate * s)) for s in (attack_s, decay_s))

    def begin(self) -> list:
        return [0.0]

    def sample(self, held: list, x: float) -> float:
        size = abs(x)
        held[0] += (self.up if size > held[0] else self.down) * (size - held[0])
        return x * min(self.most, self.level / held[0]) if held[0] > 0 else 0.0


class Squelch(Stage):
    """Opens when the smoothed power reaches ``on`` dB, closes when it falls below ``off`` dB and has been open for ``hold_s``."""

    def __init__(self, rate: float, on: float, off: float, smooth_s: float = 0.01, hold_s: float = 0.1):
        if off > on:
            raise ValueError("a squelch closes below the level at which it opens")
        self.on, self.off, self.hold = 10 ** (on / 10), 10 ** (off / 10), round(rate * hold_s)
        self.share = 1 - math.exp(-1 / (rate * smooth_s))

    def begin(self) -> list:
        return [0.0, 0, 0]  # power, open, samples it has been open for

    def sample(self, held: list, x: float) -> float | None:
        held[0] += self.share * (x * x - held[0])
        if not held[1] and held[0] >= self.on:
            held[1], held[2] = 1, 0
        elif held[1]:
            held[2] += 1
            if held[0] < self.off and held[2] >= self.hold:
                held[1] = 0
        return x if held[1] else None


def staged(blocks: DataFrame, keys: list[str], at: str, samples: str, reset: str, stage: Stage) -> DataFrame:
    """keys and ``AUDIO`` of each key's blocks."""
    return carried(blocks, keys, [at, samples, reset], stage, AUDIO, [at])


def envelope(i: Column, q: Column) -> Column:
    """Amplitude detection: magnitudes of an array's complex samples without their mean."""
    size = F.zip_with(i, q, lambda a, b: F.sqrt(a * a + b * b))
    mean = F.aggregate(size, F.lit(0.0), lambda s, x: s + x) / F.size(size)
    return F.transform(size, lambda x: x - mean)


def turns(i: Column, q: Column) -> Column:
    """Frequency detection: the angle from each complex sample to the next, in turns."""
    def turn(k: Column) -> Column:
        a, b, c, d = F.get(i, k), F.get(q, k), F.get(i, k - 1), F.get(q, k - 1)
        return F.atan2(b * c - a * d, a * c + b * d) / (2 * math.pi)

    return F.when(F.size(i) > 1, F.transform(F.sequence(F.lit(1), F.size(i) - 1), turn)).otherwise(F.array().cast("array<double>"))


def shifted_levels(i: Column, q: Column, unit: int) -> Column:
    """Frequency-shift detection: the mean turn of every ``unit`` samples; what is left at the end is dropped."""
    t = turns(i, q)
    part = lambda k: F.aggregate(F.slice(t, k * unit + 1, unit), F.lit(0.0), lambda s, x: s + x) / unit
    n = F.floor(F.size(t) / unit).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), part)).otherwise(F.array().cast("array<double>"))
