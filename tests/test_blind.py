"""Blind estimates against planted signals, and snippets and quantiles on small rows of their own."""

from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import blind as B
from spectraloom.plans.receivers import log_quantiles, normalised, snippets


def applied(spark, udf, *rows):
    df = spark.createDataFrame([(i, None if r is None else [float(x) for x in r]) for i, r in enumerate(rows)], "i int, x array<double>")
    return [r.r for r in df.select("i", udf(F.col("x")).alias("r")).orderBy("i").collect()]


def test_levels(spark):
    rnd = np.random.default_rng(3)
    at = rnd.integers(0, 4, 400)
    soft = -0.9 + 0.7 * at + rnd.normal(0, 0.03, 400)
    only_outer = np.where(rnd.integers(0, 2, 200) == 1, 3.0, -3.0)
    good, noise, flat, none, empty, outer = applied(spark, B.slice_levels(4, labels=[3, 2, 0, 1]), soft, rnd.normal(size=400), [1.0] * 80, None, [], only_outer)
    names = [3, 2, 0, 1]
    assert good.bits == [b for k in at for b in (names[k] >> 1, names[k] & 1)]
    assert good.spacing == pytest.approx(0.7, abs=0.01) and good.centre == pytest.approx(0.15, abs=0.01) and good.locked and good.quality > 0.7
    assert not noise.locked and flat.quality == 0 and not flat.locked and none.bits is None and empty.bits == []
    assert set(zip(outer.bits[::2], outer.bits[1::2])) == {(1, 1), (0, 1)}
    (mirrored,) = applied(spark, B.slice_levels(2, invert=True), [-1.0, 1.0] * 20)
    assert mirrored.bits == [1, 0] * 20 and mirrored.locked


def test_unit_rate(spark):
    bits = np.random.default_rng(1).integers(0, 2, 200)
    good, short, none = applied(spark, B.unit_rate(48_000.0, 0.5, 9_600.0), np.repeat(bits, 20), [0.0, 1.0] * 3, None)
    assert good == pytest.approx(2_400, rel=0.02) and short is None and none is None


def test_carriers_found_and_tracked(spark):
    t = np.arange(5_000) / 8_000
    x = np.cos(2 * np.pi * 1_234.5 * t) + 0.3 * np.cos(2 * np.pi * 2_800 * t) + np.random.default_rng(2).normal(0, 0.05, 5_000)
    found, silent, short, none = applied(spark, B.carriers(8_000.0, 100.0, 20.0, 4), x, [0.0] * 2_048, [1.0] * 100, None)
    assert [c.hz for c in found[:2]] == [pytest.approx(1_234.5, abs=0.5), pytest.approx(2_800, abs=0.5)] and silent == short == none == []
    tracked = B.track_carrier(8_000.0, 1_000.0, 800)
    at = np.arange(800, 800 + 2_500) / 8_000
    df = spark.createDataFrame([((0.5 * np.cos(2 * np.pi * 1_001 * at)).tolist(), 800), (None, None)], "x array<double>, s long")
    points, nothing = [r.p for r in df.select(tracked("x", "s").alias("p")).collect()]
    assert len(points) == 3 and nothing == [] and points[0].t_s == pytest.approx(0.1)
    assert all(p.amplitude == pytest.approx(0.5, abs=0.02) for p in points)
    assert points[2].phase - points[0].phase == pytest.approx(2 * np.pi * 0.2, abs=0.05)


def test_comb(spark):
    rnd = np.random.default_rng(4)
    lines = [*(1e6 + 347_300.0 * k + rnd.uniform(-300, 300) for k in range(9)), 2.011e6, 3.207e6, 1.77e6]
    comb, loose, few, none = applied(spark, B.combs(0.0, 2e7), lines, rnd.uniform(0, 2e7, 7), [1e6, 2e6], None)
    assert comb.flagged and comb.members >= 9 and comb.spacing == pytest.approx(347_300, rel=1e-3) and comb.chance < 0.05
    assert not loose.flagged and (few.members, few.spacing, few.flagged) == (0, None, False) and none.members == 0


def test_combs_by_chance():
    """Uniform lines are flagged no more often than the chance says; planted grids are found among loose lines."""
    rnd = np.random.default_rng(6)
    flagged = sum(np.exp(B.best_grid(np.sort(rnd.uniform(0, 2e7, n)), 2e7, 1500.0, 1e5, 2e6)[2]) < 0.05 for n in (5, 12, 25, 40) for _ in range(15))
    assert flagged <= 6
    for spacing in (120e3, 511_111.0, 1.3e6):
        grid = 2e6 + spacing * np.arange(10) + rnd.uniform(-700, 700, 10)
        held, step, chance = B.best_grid(np.sort(np.concatenate([grid, rnd.uniform(0, 2e7, 12)])), 2e7, 1500.0, 1e5, 2e6)
        assert abs(step / spacing - 1) < 1e-3 and held.sum() >= 10 and chance < np.log(0.05)


def test_tails():
    got = np.exp(B.tails(6, np.array([0.3, 1e-9])))
    want = [sum(comb(6, j) * 0.3**j * 0.7 ** (6 - j) for j in range(k, 7)) for k in range(7)]
    assert got[0] == pytest.approx(want) and got[1, 1] == pytest.approx(6e-9, rel=1e-6)


def test_lattice_rates():
    rnd = np.random.default_rng(8)
    for unit in (1.0, 0.37, 2.9):
        at = np.cumsum(rnd.integers(1, 6, 300)) * unit + rnd.normal(0, 0.03 * unit, 300)
        assert B.lattice_rate(np.sort(at), 5.0) == pytest.approx(1 / unit, rel=2e-3)
    assert B.lattice_rate(np.arange(8.0), 5.0) is None


def test_snippets_and_their_scale(spark):
    blocks = spark.createDataFrame([(k, [float(4 * k + i) for i in range(4)]) for k in (0, 1, 3)], "b long, x array<double>")
    boxes = spark.createDataFrame([(1, 2, 7), (2, 5, 15), (3, 40, 44), (4, 3, 3)], "box int, lo long, hi long")
    got = {r.box: r.x for r in snippets(blocks, boxes, "b", "x", 4, ["box"], "lo", "hi").collect()}
    assert got == {1: [2, 3, 4, 5, 6], 2: [5, 6, 7, 12, 13, 14]}
    rows = spark.createDataFrame([([1.0, 3.0],), ([5.0, 5.0],), ([],), (None,)], "x array<double>")
    assert [r.y for r in rows.select(normalised(F.col("x")).alias("y")).collect()] == [[-1, 1], [0, 0], [], None]


def test_log_quantiles(spark):
    rows = spark.createDataFrame([("a", 1.0)] * 9 + [("a", 1e9), ("a", None), ("b", 0.0), ("c", None)], "k string, s double")
    got = {r.k: (r.p50, r.p99) for r in log_quantiles(rows, ["k"], "s", {"p50": 0.5, "p99": 0.99}, 1e-2, 2, 20).collect()}
    assert got == {"a": (pytest.approx(10**0.25), pytest.approx(1e-2 * 10 ** (19.5 / 2))), "b": (pytest.approx(1e-2 * 10**0.25),) * 2}
