"""Planted pilots and pulse trains, and clusters that are joined one by one, in one piece, in blocks, in batches and in streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import assigning as A
from spectraloom.operators import demod as D
from spectraloom.streaming.carried import drained_carried


def cut(x, sizes, first=0):
    out, at = [], 0
    while at < len(x):
        n = sizes()
        out.append((first + at, [float(v) for v in x[at : at + n]], False))
        at += n
    return out


def run(fold, blocks):
    state, out = fold.start(), []
    for b in blocks:
        out += fold.step(state, b)
    return out


def multiplex(offset, noise, rng, n=60_000, rate=192_000.0):
    """A pilot off by some hertz, and a slow tone on twice its phase."""
    t = np.arange(n) / rate
    phase = 2 * np.pi * (19_000 + offset) * t + 1.1
    tone = 0.4 * np.sin(2 * np.pi * 300 * t)
    return 0.1 * np.cos(phase) + tone * np.cos(2 * phase) + noise * rng.standard_normal(n), tone


@pytest.mark.parametrize("offset", [-6.0, 0.0, 4.0])
def test_subcarrier_follows_its_pilot(offset):
    """At noise three times the pilot's amplitude."""
    x, tone = multiplex(offset, 0.1, np.random.default_rng(1))
    out = run(D.SubcarrierFold(D.PilotRules(192_000.0, 19_000.0, every=32)), cut(x, lambda: 4096))
    late = [o for o in out if o[0] > 30_000]
    assert all(o[4] for o in late) and np.mean([o[3] for o in late]) == pytest.approx(offset, abs=0.7) and np.mean([o[2] for o in late]) == pytest.approx(0.1, rel=0.15)
    value = np.array([o[1] for o in late])
    want = np.array([tone[o[0] : o[0] + 32].mean() for o in late])
    assert np.corrcoef(value, want)[0, 1] > 0.97


def test_noise_is_not_locked_for_long():
    out = run(D.SubcarrierFold(D.PilotRules(192_000.0, 19_000.0)), cut(np.random.default_rng(2).standard_normal(40_000), lambda: 999))
    assert np.mean([o[4] for o in out]) < 0.6


def test_subcarrier_does_not_depend_on_blocks():
    x, _ = multiplex(2.0, 0.05, np.random.default_rng(3), 3000)
    fold, sizes = D.SubcarrierFold(D.PilotRules(192_000.0, 19_000.0)), random.Random(1)
    whole = run(fold, cut(x, lambda: 10**9))
    assert len(whole) == 3000 // 16 and all(run(fold, cut(x, n)) == whole for n in (lambda: 1, lambda: sizes.randrange(1, 300)))
    broken = run(fold, cut(x, lambda: 500) + [(s + 9999, v, False) for s, v, _ in cut(x, lambda: 500)])
    assert [b[1:] for b in broken[len(whole) :]] == [w[1:] for w in whole]


def pulses(frames, n, rules, noise, rng):
    """Magnitudes with frames of bits at some places."""
    x = noise * np.abs(rng.standard_normal(n))
    for at, bits in frames:
        slots = np.zeros(rules.preamble + 2 * rules.bits)
        slots[list(rules.pulses)] = 1
        slots[rules.preamble + 2 * np.arange(rules.bits) + (1 - np.asarray(bits))] = 1
        x[at : at + rules.length] += np.repeat(slots, rules.half)
    return x


def test_pulse_frames_are_found():
    rules, rng = D.PulseRules(), np.random.default_rng(4)
    frames = [(at, rng.integers(0, 2, rules.bits)) for at in np.cumsum(rng.integers(rules.length + 5, 700, 60))]
    x = pulses(frames, int(frames[-1][0]) + 900, rules, 0.15, rng)
    got = run(D.PulseFold(rules), cut(x, lambda: 512))
    want = {int(at): "".join(map(str, bits)) for at, bits in frames}
    assert {a: b for a, b, *_ in got} == want and all(q > 0.5 and s > 0.6 for *_, s, q in got)
    sizes = random.Random(5)
    for n in (lambda: 1, lambda: sizes.randrange(1, 200)):
        assert run(D.PulseFold(rules), cut(x[:4000], n)) == run(D.PulseFold(rules), cut(x[:4000], lambda: 10**9))
    fold = D.PulseFold(rules)
    state = fold.start()
    for b in cut(x, lambda: 64):
        list(fold.step(state, b))
        assert len(state["rest"]) <= rules.length + rules.half


def test_noise_gives_few_frames():
    """Under one frame in 20,000 samples of noise at the score that is asked for."""
    rng, rules = np.random.default_rng(6), D.PulseRules()
    assert len(run(D.PulseFold(rules), cut(np.abs(rng.standard_normal(200_000)), lambda: 4096))) <= 10


def test_a_break_drops_the_frame_it_cuts(spark):
    rules, rng = D.PulseRules(), np.random.default_rng(7)
    x = pulses([(50, rng.integers(0, 2, 56)), (600, rng.integers(0, 2, 56))], 1200, rules, 0.05, rng)
    assert len(run(D.PulseFold(rules), [(0, x[:700].tolist(), False), (700, x[700:].tolist(), False)])) == 2
    for second in ((701, x[700:].tolist(), False), (700, x[700:].tolist(), True), (700, None, False)):
        assert [o[0] for o in run(D.PulseFold(rules), [(0, x[:700].tolist(), False), second])] == [50]
    rows = [("r", *b) for b in cut(x, lambda: 100)]
    df = spark.createDataFrame(rows, "receiver string, at long, samples array<double>, reset boolean").orderBy(F.rand(2))
    assert sorted(tuple(r)[1:] for r in D.pulse_frames(df, ["receiver"], "at", "samples", "reset", rules).collect()) == run(D.PulseFold(rules), cut(x, lambda: 100))
    found = D.subcarrier(df, ["receiver"], "at", "samples", "reset", D.PilotRules(1000.0, 100.0)).collect()
    assert sorted(tuple(r)[1:] for r in found) == run(D.SubcarrierFold(D.PilotRules(1000.0, 100.0)), cut(x, lambda: 100))


def test_clusters_are_joined_one_by_one():
    fold = A.ClusterFold([1.0, 1.0, 1.0, 1.0])
    state = fold.start()
    go = lambda i, *v: fold.step(state, (i, i, [None if x is None else {"value": x, "spread": 0.0} for x in v]))[0]
    assert go(1, 0.0, 0.0, 0.0, None) == (1, 1, None, True, 1)
    assert go(2, 0.5, 0.5, 0.5, 7.0)[1:] == (1, 0.5, False, 2)
    assert go(3, 0.0, 0.0, None, None)[1:4] == (2, None, True)  # two shared fields aren't enough
    assert go(4, 0.25, 0.25, 0.25, 11.0)[1] == 3  # the fourth field rules the first cluster out
    assert go(5, 1.5, 1.5, 1.5, None)[1] == 4
    assert go(6, 1.0, 1.0, 1.0, None)[1] == 4  # 0.5 from the fourth, 0.75 from the first
    assert fold.step(state, (7, 7, None))[0][1:4] == (5, None, True)


def test_clusters_do_not_depend_on_files(spark, tmp_path):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), (k + 1) * 1_000_000, k, [None if rng.random() < 0.1 else (float(rng.choice([0, 5, 9]) + rng.gauss(0, 0.3)), 0.2) for _ in range(4)]) for k in range(120)]
    shape = f"site string, t_us long, signature long, fields {A.FIELDS}"
    df = spark.createDataFrame(rows, shape)
    want = sorted((s, *r) for s in "ab" for fold in [A.ClusterFold([1.0] * 4)] for state in [fold.start()] for row in rows if row[0] == s for r in fold.step(state, row[1:]))
    key = lambda r: [x if not isinstance(x, float) else round(x, 9) for x in r]
    assert [key(r) for r in sorted(map(tuple, A.assigned_clusters(df.orderBy(F.rand(1)), ["site"], [1.0] * 4).collect()), key=lambda r: r[:2])] == [key(r) for r in sorted(want, key=lambda r: r[:2])]
    parts = df.withColumn("ts", F.timestamp_micros("t_us"))
    for k in (1, 2, 0):
        parts.where(F.col("signature") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "clusters", ["site"], A.SIGNATURE, A.ClusterFold([1.0] * 4), A.ASSIGNED, "ts", "1 hour")
    assert [key(r) for r in sorted(map(tuple, got.collect()), key=lambda r: r[:2])] == [key(r) for r in sorted(want, key=lambda r: r[:2])] and math.isfinite(want[0][1] or 0)
