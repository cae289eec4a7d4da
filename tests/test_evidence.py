import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import evidence as E
from spectraloom.operators import paths as P


def test_a_delayed_copy_is_a_second_path(spark):
    rng = random.Random(4)
    x = [rng.random() for _ in range(80)]
    other = [rng.random() for _ in range(80)]
    rows = [(1, i, v) for i, v in enumerate(x)] + [(2, i + 3, v / 2) for i, v in enumerate(x)] + [(3, i, v) for i, v in enumerate(other)] + [(4, i, 1.0) for i in range(80)]
    s = spark.createDataFrame(rows, "k int, at int, x double")
    pairs = spark.createDataFrame([(1, 2), (2, 1), (1, 3), (1, 4)], "a int, b int")
    lags = E.lag_correlations(s, pairs, "k", "at", "x", 5)
    got = {(r.a, r.b): r for r in E.best_delay(lags).collect()}
    assert set(got) == {(1, 2), (2, 1), (1, 3)}  # a constant side has no correlation
    assert (got[1, 2].lag, got[2, 1].lag) == (3, -3) and math.isclose(got[1, 2].peak, 1)
    for r in lags.where("a = 1 and b = 3").collect():
        both = [(x[i], other[i + r.lag]) for i in range(80) if 0 <= i + r.lag < 80]
        assert r.n == len(both) and math.isclose(r.r, np.corrcoef(np.array(both).T)[0, 1], abs_tol=1e-12)
    support = {(r.a, r.b): (r.segments, r.support) for r in E.path_support(s, E.best_delay(lags), "k", "at", "x", 20).collect()}
    assert support[1, 2] == (4, 4)


@pytest.mark.parametrize(
    "change,verdict",
    [({}, "related"), ({"ia": "x", "ib": "y"}, "independent"), ({"ia": "x"}, "related"), ({"overlap": 1.0}, "undecidable"), ({"overlap": None}, "undecidable"), ({"peak": 0.5}, "independent"), ({"dominance": 1.2}, "undecidable"), ({"support": 2}, "undecidable"),
     ({"segments": 9}, "undecidable"), ({"itself": 0.8}, "undecidable"), ({"lag": 0.015}, "undecidable"), ({"lag": 0.2}, "independent"), ({"lag": -0.05}, "undecidable"), ({"la": None}, "undecidable"), ({"lb": -60.0}, "undecidable"), ({"lb": -9.5}, "related")],
)
def test_path_verdict(spark, change, verdict):
    v = {"ia": None, "ib": None, "overlap": 5.0, "resolution": 0.01, "peak": 0.9, "dominance": 2.0, "support": 4, "segments": 5, "itself": None, "lag": 0.05, "la": -10.0, "lb": -20.0} | change
    kinds = {"ia": "string", "ib": "string", "support": "int", "segments": "int"}
    assert spark.range(1).select(E.path_verdict(*[F.lit(v[k]).cast(kinds.get(k, "double")) for k in v]).alias("x")).first().x == verdict


def test_ranges(spark):
    z = lambda x, lo, hi: spark.range(1).select(E.outside(F.lit(x), F.lit(lo), F.lit(hi)).alias("z")).first().z
    assert (z(5.0, 4.0, 6.0), z(8.0, 4.0, 6.0), z(3000.0, 2400.0, 2400.0), z(1.0, 0.0, 0.0)) == (0.0, 2.0 / 1.5, 1.0, math.inf)


def test_unmeasured_fields_rule_nothing_out(spark):
    m = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "fsk", 100.0, 10.0, True, ["RDS"], 5.0), (3, "psk", 100.0, 10.0, True, [], 5.0)], "row int, family string, bandwidth double, rate double, bursty boolean, features array<string>, centre double")
    recipes = [("a", ["fsk"], (90.0, 110.0), (9.0, 11.0), True, ["rds"], None), ("b", ["fsk/2"], (90.0, 110.0), (9.0, 11.0), None, None, (0.0, 9.0)), ("c", ["fsk"], (90.0, 110.0), (9.0, 11.0), True, ["rds"], (0.0, 9.0))]
    got = {(r.row, r.recipe): (r.outcome, r["rank"], r.reason) for r in E.rank_recipes(m, recipes, "row").collect()}
    assert {got[1, k] for k in "abc"} == {("none", None, "too few compared")}
    assert got[2, "c"] == ("fit", 1, None) and got[2, "a"] == ("fit", 2, None)  # the band speaks only in a tie
    assert got[2, "b"] == ("partial", 3, None)  # coarser than the recipe's family: no evidence either way
    assert {got[3, k] for k in "abc"} == {("none", None, "other family")}


def test_check_tally_equals_brute_force(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(40) for _ in range(9)]
    rows = []
    for i in range(300):
        v = 0
        for b in base:
            v ^= b if rng.random() < 0.5 else 0
        rows.append(("hot", v.to_bytes(5, "big")))
    rows += [("few", b"\x00\x12\x34"), ("few", b"\x12\x34\x00"), ("few", b"\xaa\xaa\xaa"), ("few", None), ("few", b"\x12\x34\x00")]
    got = {r.k: (r.tested, r.distinct, r.independent) for r in E.check_tally(spark.createDataFrame(rows, "k string, raw binary"), ["k"], "raw", 4).collect()}
    frames = {v for k, v in rows if k == "hot"}
    matrix = np.array([[1] + [b >> i & 1 for b in v for i in range(8)] for v in frames])
    rank = 0
    for c in range(matrix.shape[1]):
        at = np.flatnonzero(matrix[rank:, c]) + rank
        if len(at):
            matrix[[rank, at[0]]] = matrix[[at[0], rank]]
            others = np.flatnonzero(matrix[:, c])
            matrix[others[others != rank]] ^= matrix[rank]
            rank += 1
    assert got["hot"][0] == 300 and got["hot"][2] == rank <= 10
    assert got["few"] == (5, 1, 1)


def test_interference(spark):
    j = lambda *v: tuple(spark.range(1).select(E.jamming(*[F.lit(x).cast("double") for x in v]).alias("j")).first().j)
    assert j(7, None, None, None) == ("jamming", 0.6) and j(0, None, None, None) == ("quiet", 0.0)
    assert j(7, 10, 1, 0) == ("jamming", 0.95) and j(7, 10, 9, 0) == ("jamming", 0.75) and j(7, 10, 10, 0) == ("jamming", 0.6)
    assert j(0, 10, 1, 0) == ("blockage", 0.6) and j(0, 10, 10, 6) == ("blockage", 0.6) and j(None, 0, 0, None) == ("quiet", 0.0)


def test_false_positions(spark):
    e = spark.createDataFrame([("a", 0.0, 1, 5, 1.0, 0.0, 0.0, 0.0), ("a", 1.0, 2, 5, 3.0, 1000.0, 0.0, 0.0), ("a", 1.0, 3, 2, 0.1, 9e9, 0.0, 9.0), ("b", 0.0, 1, 5, None, 0.0, 0.0, None), ("b", 2.0, 2, None, 1.0, 100.0, 0.0, 0.1)], "k string, t double, id int, locked int, spread_db double, x double, y double, clock double")
    got = {r.k: tuple(r)[1:] for r in E.false_positions(e, "k", "t", "id").collect()}
    assert got == {"a": (1, 1, 0, 0.8), "b": (0, 0, 0, 0.0)}


def test_traced_paths(spark):
    rows, at = [], 0

    def add(device, t, long, f):
        nonlocal at
        at += 1
        rows.append((device, at, t, t + long, f, 10.0))
        return at

    saw = [add("saw", k * 1.0 + i * 0.2, 0.2, 100.0 + 10 * i) for k in range(2) for i in range(5)]
    ramp = [add("ramp", i * 0.2, 0.2, 500.0 - 8 * i) for i in range(4)]
    hops = [add("hop", i * 0.1, 0.1, f) for i, f in enumerate([100.0, 300.0, 200.0, 100.0, 400.0])]
    for i in range(8):
        add("carrier", i * 0.1, 0.1, 100.0 + i % 2)
        add("pair", i * 0.1, 0.1, 100.0 + 200 * (i % 2))  # two channels only
        add("bursts", i * 5.0, 0.1, 100.0 + 50 * (i % 4))  # too far apart to link
    rows.append(("hop", 99, None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "device string, id long, t0 double, t1 double, f double, w double")
    got = {r.device: (r.kind, r.parts, r.members) for r in P.traced_paths(df, "device", "id", "t0", "t1", "f", "w").collect()}
    assert got == {"saw": ("sweep", 2, saw), "ramp": ("chirp", 1, ramp), "hop": ("hop", 1, hops)}
