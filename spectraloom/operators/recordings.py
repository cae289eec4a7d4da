"""Long recordings that lie in blocks of samples: spectra over block borders, and symbols from a waveform whose clock drifts.

A block has the absolute number of its first sample. Where the next number isn't the one that follows, or the block says
``reset``, the recording breaks: no frame spans a break, and what is carried starts anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators.carried import carried, schema_of, to_batch
from spectraloom.operators.spectral import taper


def segments(blocks: DataFrame, keys: list[str], at: str, samples: str, reset: str | None = None) -> DataFrame:
    """``blocks`` with ``segment`` (from 0) and ``origin``, the number of its first sample, for each block.

    The windows see one narrow row a block, not the samples; blocks of a key differ in ``at``. A null block is a break.
    """
    narrow = blocks.where(F.col(samples).isNotNull()).select(*keys, at, F.size(samples).alias("__n"), (F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)).alias("__r"))
    by = Window.partitionBy(*keys).orderBy(at)
    follows = (F.lag(F.col(at) + F.col("__n")).over(by) == F.col(at)) & ~F.col("__r")
    told = narrow.withColumn("__b", F.when(F.row_number().over(by) == 1, 0).otherwise((~follows).cast("int"))).withColumn("segment", F.sum("__b").over(by))
    told = told.withColumn("origin", F.min(at).over(Window.partitionBy(*keys, "segment")))
    same = [F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys]
    on = F.col(f"b.{at}") == F.col(f"t.{at}")
    for s in same:
        on = on & s
    return blocks.where(F.col(samples).isNotNull()).alias("b").join(told.select(*keys, at, "segment", "origin").alias("t"), on).select("b.*", "t.segment", "t.origin")


def stft(blocks: DataFrame, keys: list[str], at: str, samples: str, n: int, hop: int, reset: str | None = None, kind: str = "hann", group: int = 64) -> DataFrame:
    """keys, segment, frame, at, power: the spectrum of every frame of ``n`` samples, ``hop`` apart from each segment's first sample.

    ``power`` has the bins 0 to n / 2 over the window's power. Frames don't depend on how a recording is cut into blocks.
    A block's samples go to the groups of ``group`` frames that they take part in, so a recording is worked on in
    parallel, and a task holds one group; what overlaps is sent twice.
    """
    span = group * hop  # from one group's first sample to the next one's
    reach = (group - 1) * hop + n
    first = F.col(at) - F.col("origin")
    lo = F.greatest(F.lit(0), F.floor((first - reach) / span) + 1)
    hi = F.floor((first + F.size(samples) - 1) / span)
    sent = segments(blocks, keys, at, samples, reset).where(F.size(samples) > 0).withColumn("__g", F.explode(F.sequence(lo, F.greatest(lo, hi))))
    begin = F.greatest(F.lit(0), F.col("__g") * span - first)
    end = F.least(F.size(samples).cast("long"), F.col("__g") * span + reach - first)
    kept = sent.select(*keys, "segment", "origin", "__g", (first + begin).alias("__from"), F.slice(samples, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int")).cast("array<double>").alias("__x")).where(F.size("__x") > 0)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = schema_of(kept, keys, "segment long, frame long, at long, power array<double>")
    arrow, w = to_arrow_schema(schema), taper(kind, n)
    names = list(keys)

    def frames(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("__from")
        x = np.concatenate([np.asarray(v.values) for v in table.column("__x")])
        key = [table.column(k)[0].as_py() for k in names]
        segment, origin, g = (table.column(c)[0].as_py() for c in ("segment", "origin", "__g"))
        out = []
        if len(x) >= n:
            spectra = np.abs(np.fft.rfft(np.lib.stride_tricks.sliding_window_view(x, n)[::hop][:group] * w, axis=1)) ** 2 / (w**2).sum()
            out = [(*key, segment, g * group + k, origin + (g * group + k) * hop, p.tolist()) for k, p in enumerate(spectra)]
        return pa.Table.from_batches([to_batch(out, arrow)])

    return kept.groupBy(*keys, "segment", "__g").applyInArrow(frames, schema)


@dataclass(frozen=True)
class ClockRules:
    """Samples a symbol, the loop's bandwidth in symbols, and how far the rate may be off."""

    period: float
    bandwidth: float = 0.01
    most_ppm: float = 1000.0


#: What ``ClockFold`` gives for each symbol: its number, the place of its first sample, its mean value.
SYMBOLS = "symbol long, at double, value double"


class ClockFold:
    """Symbols of a two-level waveform, one value each, by a second-order loop on the crossings between them.

    Rows: at (the number of the first sample), samples, reset. The value of a symbol is the waveform's mean over it, with parts
    of samples at its ends. The error is the mean over the second half of the symbol before and the first half of this one,
    which is 0 where the level changes between them in the middle, times the change, over the power. Places are a whole and
    a part of a sample, and sums are taken symbol by symbol, so results don't depend on how samples fall into blocks.
    """

    def __init__(self, rules: ClockRules):
        self.rules = rules
        theta = rules.bandwidth / (0.707 + 1 / (4 * 0.707))
        whole = 1 + 2 * 0.707 * theta + theta * theta
        self.fast, self.slow = 4 * 0.707 * theta / whole, 4 * theta * theta / whole

    def start(self) -> dict:
        return {"symbol": 0, "next": None, "rest": [], **self._fresh()}

    @staticmethod
    def _fresh() -> dict:
        return {"at": None, "part": 0.0, "rate": 0.0, "last": None, "power": 0.0, "before": None}

    @staticmethod
    def _mean(x: list[float], first: int, part: float, length: float) -> float:
        """The mean of the waveform from place first + part of ``x`` over ``length``; sample i covers [i, i + 1)."""
        end = part + length
        whole = int(end)
        total = math.fsum(x[first : first + whole]) - part * x[first]
        if end > whole:
            total += (end - whole) * x[first + whole]
        return total / length

    def step(self, state: dict, row: tuple) -> Iterator[tuple]:
        at, samples, reset = row
        if reset or samples is None or (state["next"] is not None and at != state["next"]):
            state.update(self._fresh() | {"rest": []})
        samples = samples or []
        state["next"] = at + len(samples)
        if not samples:
            return
        if state["at"] is None:
            state["at"] = at
        x = state["rest"] + list(samples)
        base = at + len(samples) - len(x)
        period, limit = self.rules.period, self.rules.most_ppm * 1e-6
        while True:
            length = period * (1 + state["rate"])
            first = state["at"] - base
            if first + state["part"] + length >= len(x):
                break
            value = self._mean(x, first, state["part"], length)
            error = 0.0
            if state["last"] is not None:
                middle, part = state["before"]
                between = self._mean(x, middle - base, part, length)
                state["power"] = 0.98 * state["power"] + 0.02 * value * value if state["power"] else value * value
                if state["power"] > 0:
                    error = max(-0.5, min(0.5, (state["last"] - value) * between / state["power"] / 2))
            yield state["symbol"], state["at"] + state["part"], value
            state["symbol"] += 1
            state["rate"] = max(-limit, min(limit, state["rate"] + self.slow * error))
            half = state["part"] + length / 2
            state["before"] = [state["at"] + int(half), half - int(half)]
            place = state["part"] + period * (1 + state["rate"] + self.fast * error)
            state["last"], state["at"], state["part"] = value, state["at"] + int(place), place - int(place)
        keep = min(state["at"], state["before"][0] if state["before"] else state["at"]) - base
        state["rest"] = x[max(0, keep) :]

    def end(self, state: dict) -> tuple:
        return ()


def symbols(blocks: DataFrame, keys: list[str], at: str, samples: str, reset: str, rules: ClockRules) -> DataFrame:
    """keys and ``SYMBOLS`` of each key's waveform; the state between blocks is one or two symbols' samples."""
    return carried(blocks, keys, [at, samples, reset], ClockFold(rules), SYMBOLS, [at])
