"""Spectra and symbols of recordings in blocks against whole recordings, planted clocks, batches and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators.recordings import SYMBOLS, ClockFold, ClockRules, stft, symbols
from spectraloom.operators.spectral import taper
from spectraloom.streaming.carried import drained_carried


def cut(x, sizes, first=0):
    out, at = [], 0
    while at < len(x):
        n = sizes()
        out.append((first + at, [float(v) for v in x[at : at + n]], False))
        at += n
    return out


@pytest.mark.parametrize(("n", "hop", "group"), [(16, 8, 4), (32, 32, 3), (16, 5, 64), (8, 20, 2)])
def test_frames_equal_whole_recording(spark, n, hop, group):
    rng, random_ = np.random.default_rng(1), random.Random(2)
    rows, want = [], {}
    for key in ("a", None):
        at, segment = 1000, 0
        for size, jump, reset in ((500, 0, False), (333, 7, False), (n - 1, 0, True), (n, 3, False), (200, 0, True)):
            x = rng.standard_normal(size)
            at += jump
            part = cut(x, lambda: random_.randrange(1, 90), at)
            rows += [(key, a, s, reset and k == 0) for k, (a, s, _) in enumerate(part)]
            for f in range(max(0, (size - n) // hop + 1) if size >= n else 0):
                want[key, segment, f] = (at + f * hop, np.abs(np.fft.rfft(x[f * hop : f * hop + n] * taper("hann", n))) ** 2 / (taper("hann", n) ** 2).sum())
            at += size
            segment += 1
    rows.append(("b", 0, None, False))
    rows.append(("b", 1, [], False))
    random_.shuffle(rows)
    df = spark.createDataFrame(rows, "receiver string, at long, samples array<double>, reset boolean")
    got = {(r["receiver"], r["segment"], r["frame"]): r for r in stft(df, ["receiver"], "at", "samples", n, hop, "reset", group=group).collect()}
    assert set(got) == set(want)
    for k, (at, power) in want.items():
        assert got[k]["at"] == at and np.allclose(got[k]["power"], power)


def waveform(bits, period, noise, rng, start=0.0):
    """A level of 1 or -1 for each bit; a sample is the mean over its unit of time, plus noise."""
    edges = start + period * np.arange(len(bits) + 1)
    n = int(edges[-1])
    fine = 40
    t = (np.arange(n * fine) + 0.5) / fine
    at = np.clip(np.searchsorted(edges, t, side="right") - 1, 0, len(bits) - 1)
    return (2 * np.asarray(bits)[at] - 1).reshape(n, fine).mean(axis=1) + noise * rng.standard_normal(n)


def run(fold, blocks):
    state, out = fold.start(), []
    for b in blocks:
        out += fold.step(state, b)
    return out


@pytest.mark.parametrize("ppm", [-400, -100, 0, 150, 500])
@pytest.mark.parametrize("period", [4.0, 7.3])
def test_no_symbol_slips(ppm, period):
    """20,000 symbols whose clock is off: without the loop they would be off by whole symbols."""
    rng = np.random.default_rng(abs(ppm) + int(period))
    bits = rng.integers(0, 2, 20_000)
    x = waveform(bits, period * (1 + ppm * 1e-6), 0.25, rng)
    out = run(ClockFold(ClockRules(period)), cut(x, lambda: 4096))
    got = np.array([v > 0 for _, _, v in out])
    assert len(bits) - 2 <= len(got) <= len(bits) and (got == bits[: len(got)]).mean() > 0.9999
    k = np.arange(len(out))[5000:]
    assert abs(np.polyfit(k, [a for _, a, _ in out][5000:], 1)[0] / (period * (1 + ppm * 1e-6)) - 1) < 30e-6


def test_a_wrong_phase_is_found():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, 3000)
    out = run(ClockFold(ClockRules(8.0, bandwidth=0.03)), cut(waveform(bits, 8.0, 0.1, rng, start=3.0), lambda: 100))
    late = [(a - 3.0) / 8.0 for _, a, _ in out[500:]]
    assert max(abs(x - round(x)) for x in late) < 0.1


def test_symbols_do_not_depend_on_blocks():
    rng, sizes = np.random.default_rng(4), random.Random(4)
    x = waveform(rng.integers(0, 2, 800), 5.01, 0.2, rng)
    whole = run(ClockFold(ClockRules(5.0)), cut(x, lambda: 10**9))
    assert len(whole) >= 798
    for n in (lambda: 1, lambda: 64, lambda: sizes.randrange(1, 40)):
        assert run(ClockFold(ClockRules(5.0)), cut(x, n)) == whole
    fold = ClockFold(ClockRules(5.0))
    state = fold.start()
    for b in cut(x, lambda: 50):
        list(fold.step(state, b))
        assert len(state["rest"]) < 3 * 5 + 2


def test_breaks_start_the_clock_anew():
    rng = np.random.default_rng(5)
    x = waveform(rng.integers(0, 2, 60), 5.0, 0.1, rng)
    one = run(ClockFold(ClockRules(5.0)), cut(x, lambda: 30))
    values = [v for *_, v in one]
    for second in ([(at + 1000, s, False) for at, s, _ in cut(x, lambda: 30)], [(at + len(x), s, k == 0) for k, (at, s, _) in enumerate(cut(x, lambda: 30))]):
        both = run(ClockFold(ClockRules(5.0)), cut(x, lambda: 30) + second)
        assert [v for *_, v in both] == values * 2 and [s for s, *_ in both] == list(range(len(both)))
    assert run(ClockFold(ClockRules(5.0)), [(0, None, False), (0, [], False), (0, [0.0] * 40, False)])[0][2] == 0.0


def test_clock_batch_and_stream(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows, want = [], []
    for key in (1, 2):
        x = waveform(rng.integers(0, 2, 300), 6.002, 0.2, rng)
        blocks = cut(x, lambda: 100, 6000 * key)
        rows += [(key, *b) for b in blocks]
        want += [(key, *s) for s in run(ClockFold(ClockRules(6.0)), blocks)]
    df = spark.createDataFrame(rows, "receiver long, at long, samples array<double>, reset boolean")
    assert sorted(map(tuple, symbols(df.orderBy(F.rand(3)), ["receiver"], "at", "samples", "reset", ClockRules(6.0)).collect())) == sorted(want)
    parts = df.withColumn("ts", F.timestamp_micros(F.col("at") * 1000)).withColumn("k", F.pmod(F.xxhash64("at"), F.lit(3)))
    for k in range(3):
        parts.where(F.col("k") == k).drop("k").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.drop("k").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "symbols", ["receiver"], ["at", "samples", "reset"], ClockFold(ClockRules(6.0)), SYMBOLS, "ts", "1 hour")
    assert sorted(map(tuple, got.collect())) == sorted(want) and math.isfinite(want[0][2])
