"""Demodulators whose state is carried from block to block: a subcarrier locked to its pilot, and frames of pulse positions.

Rows are blocks: the number of the first sample, samples, reset. A block that doesn't follow the one before, says ``reset`` or is null
breaks what is carried. Results don't depend on how samples fall into blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from spectraloom.operators.carried import carried


@dataclass(frozen=True)
class PilotRules:
    """Sample rate, pilot, the subcarrier's multiple of it, samples a result, and the loop's bandwidth in hertz."""

    rate: float
    pilot_hz: float
    multiple: int = 2
    every: int = 16
    bandwidth_hz: float = 20.0
    locked: float = 0.5


#: What ``SubcarrierFold`` gives: the place of the first sample, the subcarrier's mean, the pilot's amplitude, its offset in hertz, whether it is locked.
SUBCARRIER = "at long, value double, pilot double, offset_hz double, locked boolean"


class SubcarrierFold:
    """A second-order phase-locked loop on the pilot, sample by sample, and the signal mixed down by a multiple of its phase.

    The phase error is the quadrature part of the signal, smoothed over a loop time, over the pilot's amplitude; locked means that the smoothed
    in-phase part holds ``locked`` of the two parts' length.
    """

    def __init__(self, rules: PilotRules):
        self.rules = rules
        w = 2 * math.pi * rules.bandwidth_hz / rules.rate
        self.fast, self.slow, self.smooth = 2 * 0.707 * w, w * w, min(1.0, 4 * w)

    def start(self) -> dict:
        return {"next": None} | self._fresh()

    @staticmethod
    def _fresh() -> dict:
        return {"phase": 0.0, "step": 0.0, "i": 0.0, "q": 0.0, "power": 0.0, "sum": 0.0, "n": 0, "first": None}

    def step(self, state: dict, row: tuple) -> Iterator[tuple]:
        at, samples, reset = row
        if reset or samples is None or (state["next"] is not None and at != state["next"]):
            state.update(self._fresh())
        samples = samples or []
        state["next"] = at + len(samples)
        rules, turn = self.rules, 2 * math.pi
        nominal = turn * rules.pilot_hz / rules.rate
        phase, step, i, q, power, total, n, first = (state[k] for k in ("phase", "step", "i", "q", "power", "sum", "n", "first"))
        for k, x in enumerate(samples):
            c, s = math.cos(phase), -math.sin(phase)
            i += self.smooth * (2 * x * c - i)
            q += self.smooth * (2 * x * s - q)
            power += self.smooth * (x * x - power)
            amplitude = math.hypot(i, q)
            error = math.atan2(q, i) if amplitude > 0 else 0.0
            step += self.slow * error
            if first is None:
                first = at + k
            total += 2 * x * math.cos(rules.multiple * phase)
            n += 1
            phase = (phase + nominal + step + self.fast * error) % turn
            if n == rules.every:
                strong = amplitude > 0 and i > rules.locked * amplitude and amplitude * amplitude > 0.01 * power
                yield first, total / n, amplitude, step * rules.rate / turn, strong
                total, n, first = 0.0, 0, None
        state.update(phase=phase, step=step, i=i, q=q, power=power, sum=total, n=n, first=first)

    def end(self, state: dict) -> tuple:
        return ()


def subcarrier(blocks: DataFrame, keys: list[str], at: str, samples: str, reset: str, rules: PilotRules) -> DataFrame:
    """keys and ``SUBCARRIER`` of each key's real samples."""
    return carried(blocks, keys, [at, samples, reset], SubcarrierFold(rules), SUBCARRIER, [at])


@dataclass(frozen=True)
class PulseRules:
    """Samples a half bit, where pulses stand in the preamble (in half bits, 0 first), its length, the bits of a frame, and the least score."""

    half: int = 2
    pulses: tuple[int, ...] = (0, 2, 7, 9)
    preamble: int = 16
    bits: int = 56
    least: float = 0.6

    @property
    def length(self) -> int:
        return self.half * (self.preamble + 2 * self.bits)


#: What ``PulseFold`` gives: the frame's first sample, its bits, the preamble's score and the bits' mean contrast.
PULSE_FRAMES = "at long, bits string, score double, quality double"


class PulseFold:
    """Frames of pulse positions in magnitudes: a bit is 1 if its first half is stronger than its second.

    A preamble's score is what its weakest pulse exceeds the mean of its gaps by, over their sum. A frame begins where the score
    is ``least`` or more and no lower than at the next half bit's samples; frames don't overlap. What is carried is less than a
    frame and a half bit.
    """

    def __init__(self, rules: PulseRules):
        self.rules = rules
        on = np.zeros(rules.preamble, bool)
        on[list(rules.pulses)] = True
        self.on = np.repeat(on, rules.half)

    def start(self) -> dict:
        return {"next": None, "rest": []}

    def step(self, state: dict, row: tuple) -> Iterator[tuple]:
        at, samples, reset = row
        if reset or samples is None or (state["next"] is not None and at != state["next"]):
            state["rest"] = []
        samples = samples or []
        state["next"] = at + len(samples)
        x = np.array(state["rest"] + list(samples), float)
        base, rules = state["next"] - len(x), self.rules
        last = len(x) - rules.length - rules.half  # the last place whose frame and following scores are all there
        place = 0
        if last >= 0:
            windows = np.lib.stride_tricks.sliding_window_view(x, len(self.on))[: last + rules.half + 1]
            high = windows[:, self.on].reshape(len(windows), len(rules.pulses), rules.half).mean(axis=2).min(axis=1)
            low = windows[:, ~self.on].mean(axis=1)
            score = np.divide(high - low, high + low, out=np.zeros(len(high)), where=high + low > 0)
            top = np.lib.stride_tricks.sliding_window_view(score, rules.half + 1).max(axis=1)
            for k in np.flatnonzero((score[: last + 1] >= rules.least) & (score[: last + 1] >= top[: last + 1])).tolist():
                if k < place:
                    continue
                body = x[k + rules.half * rules.preamble : k + rules.length].reshape(rules.bits, 2, rules.half).mean(axis=2)
                sums = body.sum(axis=1)
                contrast = np.divide(np.abs(body[:, 0] - body[:, 1]), sums, out=np.zeros(rules.bits), where=sums > 0)
                yield base + k, "".join("1" if a > b else "0" for a, b in body.tolist()), float(score[k]), float(contrast.mean())
                place = k + rules.length
            place = max(place, last + 1)
        state["rest"] = x[place:].tolist() if place <= len(x) else []

    def end(self, state: dict) -> tuple:
        return ()


def pulse_frames(blocks: DataFrame, keys: list[str], at: str, samples: str, reset: str, rules: PulseRules) -> DataFrame:
    """keys and ``PULSE_FRAMES`` of each key's magnitudes."""
    return carried(blocks, keys, [at, samples, reset], PulseFold(rules), PULSE_FRAMES, [at])
