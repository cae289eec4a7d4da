"""Stages of samples: the same however a recording is cut, right on planted signals, and odd blocks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import audio as A


def run(stage, blocks):
    state, out = stage.start(), []
    for b in blocks:
        for _, samples in stage.step(state, b):
            out += samples
    return out


def cut(x, sizes):
    out, at = [], 0
    while at < len(x):
        n = sizes()
        out.append((at, [float(v) for v in x[at : at + n]], False))
        at += n
    return out


@pytest.mark.parametrize("stage", [A.Deemphasis(8000.0, 50e-6), A.Gain(8000.0), A.Squelch(8000.0, -6.0, -12.0)])
def test_stages_do_not_depend_on_blocks(spark, stage):
    x, rng = np.random.default_rng(1).standard_normal(900), random.Random(2)
    whole = run(stage, [(0, x.tolist(), False)])
    assert run(stage, cut(x, lambda: 1)) == whole == run(stage, cut(x, lambda: rng.randrange(1, 70)))
    assert run(stage, [(0, x.tolist(), False), (0, x.tolist(), True)]) == whole * 2 == run(stage, [(0, x.tolist(), False), (9999, x.tolist(), False)])
    assert run(stage, [(0, None, False), (0, [], False)]) == []
    df = spark.createDataFrame([("k", *b) for b in cut(x, lambda: 100)], "k string, at long, samples array<double>, reset boolean").orderBy(F.rand(1))
    assert [v for r in sorted(A.staged(df, ["k"], "at", "samples", "reset", stage).collect(), key=lambda r: r["at"]) for v in r["samples"]] == whole


def test_deemphasis_falls_off():
    t = np.arange(48_000) / 48_000
    size = lambda f: np.std(run(A.Deemphasis(48_000.0, 75e-6), [(0, np.sin(2 * np.pi * f * t).tolist(), False)])[4800:])
    assert size(100) == pytest.approx(1 / math.sqrt(2), rel=0.01) and size(2122) / size(100) == pytest.approx(1 / math.sqrt(2), rel=0.1)


def test_gain_levels_out():
    for scale in (0.01, 3.0):
        y = np.abs(run(A.Gain(8000.0), [(0, (scale * np.sin(0.3 * np.arange(20_000))).tolist(), False)]))
        assert 0.4 < y[8000:].max() < 0.75
    assert run(A.Gain(8000.0), [(0, [0.0, 0.0], False)]) == [0.0, 0.0]


def test_squelch_opens_holds_and_closes():
    x = [0.01] * 1000 + [1.0] * 1000 + [0.01] * 3000
    y = run(A.Squelch(8000.0, -6.0, -20.0, hold_s=0.15), [(0, x, False)])
    opened, last = next(k for k, v in enumerate(y) if v is not None), max(k for k, v in enumerate(y) if v is not None)
    assert 1000 < opened < 1100 and opened + 1200 <= last < 2600 and all(v is not None for v in y[opened:last])
    with pytest.raises(ValueError):
        A.Squelch(8000.0, -20.0, -6.0)


def test_envelope_and_shifts(spark):
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 40)
    phase = np.cumsum(np.concatenate([[0], np.repeat(np.where(bits, 0.06, -0.06), 10)])) * 2 * np.pi
    tone = 1 + 0.5 * np.sin(0.2 * np.arange(401))
    rows = [((tone * np.cos(phase)).tolist(), (tone * np.sin(phase)).tolist()), ([1.0], [0.0]), ([], [])]
    df = spark.createDataFrame(rows, "i array<double>, q array<double>")
    out = df.select(A.envelope(F.col("i"), F.col("q")).alias("e"), A.shifted_levels(F.col("i"), F.col("q"), 10).alias("s"), A.turns(F.col("i"), F.col("q")).alias("t")).collect()
    assert out[0].e == pytest.approx((tone - tone.mean()).tolist()) and [v > 0 for v in out[0].s] == bits.astype(bool).tolist()
    assert out[1].s == out[1].t == out[2].s == out[2].t == [] and out[1].e == [0.0] and out[2].e == []
