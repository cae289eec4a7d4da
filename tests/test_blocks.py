"""Operators that cut a busy key into blocks, against folds of whole keys."""

import random

import numpy as np
import pytest

from spectraloom.operators import aggregates as A
from spectraloom.operators import joins as J
from spectraloom.operators import sequences as Q


@pytest.fixture
def many_blocks(spark):
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield spark
    spark.conf.unset(name)


@pytest.mark.parametrize("raise_after, clear_after, reopen", [(2, 3, 40), (1, 1, 5), (4, 2, 0)])
def test_hysteresis_of_a_busy_key_is_that_of_the_whole_key(many_blocks, raise_after, clear_after, reopen):
    rng = random.Random(raise_after)
    rows = [(k, rng.randrange(2000), i, rng.choice([0.1, 0.2, 0.5, 0.8, 0.9, None])) for i, k in enumerate([7] * 1500 + [1, 2, 3, None] * 40 + [9])]
    got = Q.hysteresis(many_blocks.createDataFrame(rows, "k long, t long, id long, x double"), "k", "t", "id", "x", raise_after=raise_after, clear_after=clear_after, reopen=reopen)
    want = []
    for key in {r[0] for r in rows}:
        of = sorted((r for r in rows if r[0] == key), key=lambda r: r[1:3])
        steps, _ = Q.hysteresis_steps([float("nan") if r[3] is None else r[3] for r in of], [r[1] for r in of], (False, 0, 0, -1), 0.7, 0.4, raise_after, clear_after, reopen)
        want += [(r[2], key, s) for r, s in zip(of, steps)]
    assert sorted(((r.id, r.k, r.step) for r in got.collect()), key=lambda r: r[0]) == sorted(want, key=lambda r: r[0])
    assert {s for *_, s in want} >= {"raise", "clear", "hold", "quiet"}


def test_hysteresis_of_nothing_and_of_repeated_rows(spark):
    kinds = "k string, t long, id long, x double"
    assert Q.hysteresis(spark.createDataFrame([], kinds), "k", "t", "id", "x").count() == 0
    got = Q.hysteresis(spark.createDataFrame([("a", 1, 1, 0.9)] * 3 + [("a", None, 2, 0.9)], kinds), "k", "t", "id", "x").collect()
    assert sorted(r.step for r in got) == ["hold", "hold", "quiet", "raise"]


def test_quantiles_by_bins_are_those_of_all_values(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(0, 1, 501), "b": np.repeat(3.0, 40), "c": np.append(rng.exponential(1, 300), [1e300, -1e300]), "d": np.array([2.0]), None: rng.integers(0, 4, 99).astype(float)}
    rows = [(k, float(x)) for k, xs in groups.items() for x in xs] + [("a", None), ("a", float("nan")), ("e", None)]
    shares = {"q0": 0.0, "q3": 0.3, "q5": 0.5, "q1": 1.0}
    got = {r.k: r for r in A.exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", shares, 16).collect()}
    assert set(got) == {*groups, "e"} and got["e"].q5 is None
    for k, xs in groups.items():
        for name, q in shares.items():
            assert got[k][name] == pytest.approx(np.quantile(xs, q), rel=1e-9), (k, name)


def test_greedy_pairs_are_those_of_one_pass_by_cost(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(30), rng.randrange(30), rng.randrange(12) / 4) for _ in range(400)] + [(1, 2, 0.0)] * 3 + [(None, 4, 0.0), (5, None, 0.0)]
    a, b, want = set(), set(), []
    for x, y, c in sorted((p for p in pairs if None not in p), key=lambda p: (p[2], p[0], p[1])):
        if x not in a and y not in b:
            a.add(x), b.add(y), want.append((x, y, c))
    got = J.greedy_one_to_one(spark.createDataFrame(pairs, "a long, b long, cost double"), "a", "b", "cost")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert J.greedy_one_to_one(spark.createDataFrame([], "a long, b long, cost double"), "a", "b", "cost").count() == 0
