"""Evidence bits, byte codes, regions, floors, preambles and pages on small rows of their own."""

import math
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import nulls as N
from spectraloom.operators import codes as K
from spectraloom.operators import regions as R
from spectraloom.plans.surveys import paged, resolved, summarised


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_bits_of_tails(spark):
    lit = F.lit
    assert one(spark, N.binomial_tail_bits(lit(5.0), lit(5.0), 2.0**-16)) == pytest.approx(80)
    assert one(spark, N.binomial_tail_bits(lit(1.0), lit(10.0), 0.5)) == 0
    assert one(spark, N.binomial_tail_bits(lit(9.0), lit(3.0), 1.0)) == 0
    assert one(spark, N.binomial_tail_bits(lit(float("nan")), lit(3.0), 0.5)) == 0
    assert one(spark, N.poisson_tail_bits(lit(8.0), lit(2.0))) == pytest.approx((8 * math.log(4) - 6) / math.log(2))
    assert one(spark, N.poisson_tail_bits(lit(2.0), lit(0.0))) == 0
    assert one(spark, N.check_bits(lit(1), lit(16), 32.0)) == pytest.approx(28, abs=1.5)
    assert N.chance_of_word(8, 0) == 1 / 256 and N.chance_of_word(8, 1, True) == 18 / 256 and N.chance_of_word(0, 3) == 1
    assert [one(spark, N.prior_bits(lit(p))) for p in (0.25, 0.0, 1e-9, 4.0, float("nan"))] == [-2, -8, -8, 0, -8]
    assert [one(spark, N.search_bits(lit(n))) for n in (0, 1, 8)] == [0, 0, 3]
    assert one(spark, N.sync_bits(lit(4), lit(1000), 32, 0)) > 32 and one(spark, N.sync_bits(lit(0), lit(10), 8, 0)) == 0


@pytest.mark.parametrize("parity,first,polynomial", [(16, 0, 0x11D), (32, 1, 0x11D), (7, 112, 0x187)])
def test_byte_code_round_trip(parity, first, polynomial):
    field, rnd = K.ByteField(polynomial), random.Random(parity)
    for n in (1, 2, 40, 255 - parity):
        m = [rnd.randrange(256) for _ in range(n)]
        word = K.add_parity(m, parity, first, field)
        assert word[:n] == m and K.repair_bytes(word, parity, first, field) == (word, 0)
        for wrong in range(1, parity // 2 + 1):
            bad = list(word)
            for k in rnd.sample(range(len(word)), min(wrong, len(word))):
                bad[k] ^= rnd.randrange(1, 256)
            assert K.repair_bytes(bad, parity, first, field) == (word, wrong)
    bad = [x ^ rnd.randrange(1, 256) for x in word]
    assert K.repair_bytes(bad, parity, first, field)[1] == -1
    assert K.repair_bytes([1, 2], parity, first, field)[1] == -1


def test_byte_code_column(spark):
    good = bytes(K.add_parity(list(b"abc"), 4))
    df = spark.createDataFrame([(0, good), (1, b"x" + good[1:]), (2, b"xyz" + good[3:]), (3, None), (4, b"")], "i int, w binary")
    got = {r.i: (r.m and bytes(r.m), r.e) for r in df.select("i", K.correct_bytes(4)("w").alias("r")).select("i", F.col("r.message").alias("m"), F.col("r.errors").alias("e")).collect()}
    assert got == {0: (b"abc", 0), 1: (b"abc", 1), 2: (None, -1), 3: (None, -1), 4: (None, -1)}


def test_emissions_of_a_region(spark):
    power = [1.0] * 40
    for k in (14, 15, 17, 24):  # a gap of one cell is bridged, the weak cell alone doesn't count
        power[k] = 100.0 if k < 20 else 3.0
    bins = spark.createDataFrame([("a", i, p, 1.0) for i, p in enumerate(power)] + [("b", i, 1.0, -1.0) for i in range(40)], "k string, bin int, power double, floor double")
    regions = spark.createDataFrame([(k, 0, 10, 30) for k in "abc"], "k string, region int, lo int, hi int")
    (r,) = R.measured_emissions(bins, regions, ["k"], 10.0, 3.0).collect()
    assert (r.k, r.first, r.last, r.floor_ref) == ("a", 14, 17, 1.0) and r.centre == pytest.approx(46 / 3) and r.peak_db == pytest.approx(20)
    assert R.measured_emissions(bins.limit(0), regions, ["k"], 10.0, 3.0).count() == 0


def test_block_floor_of_noise_and_of_nothing(spark):
    rnd = random.Random(5)
    noise = [(0, i, sum(rnd.expovariate(1) for _ in range(8)) / 8 * 3) for i in range(4000)]
    rows = noise + [(1, 0, 0.0), (1, 1, None), (2, 0, float("inf"))]
    got = {r.f: r for r in R.block_floors(spark.createDataFrame(rows, "f int, bin int, p double"), ["f"], F.lit(0), "p", 8.0).collect()}
    assert got[0].floor == pytest.approx(3, rel=0.05) and got[0].occupancy < 0.01 and got[0].valid
    assert all((got[f].floor, got[f].occupancy, got[f].valid) == (None, 1.0, False) for f in (1, 2))


def test_preamble_and_mirror(spark):
    at = lambda s, n: (lambda r: r and tuple(r))(one(spark, R.preamble(F.lit(s), n)))
    assert at("0010101100101", 4) == (1, 6) and at("0011", 3) is None and at("", 1) is None and at("1100", 2) == (1, 2)
    arr = lambda v: F.array(*map(F.lit, v)) if v else F.array().cast("array<double>")
    assert one(spark, R.mirror_correlation(arr([3.0, 2.0, 1.0, 9.0, 1.0, 2.0, 3.0]))) == pytest.approx(1)
    assert one(spark, R.mirror_correlation(arr([1.0, 1.0, 2.0, 3.0]))) is None and one(spark, R.mirror_correlation(arr([]))) is None


def test_aliases_summaries_pages(spark):
    s = spark.createDataFrame([(1, 5, 0), (2, 1, 3), (2, 2, 1), (3, 1, 2), (3, 2, 2), (4, 1, 0), (4, 2, 0)], "k int, shift long, occupied long")
    got = {r.k: (r.by, r["shift"], r.runner_up) for r in resolved(s, ["k"], "shift", "occupied").collect()}
    assert got == {1: ("bound", 5, 0), 2: ("energy", 1, 1), 3: ("tied", None, 0), 4: ("nothing occupied", None, 0)}
    f = spark.createDataFrame([(0, None, 7, True, 5, 1), (0, None, None, None, 4, 2), (1, "a", 1, False, 3, 3), (1, None, 1, False, 4, 4)], "k int, tag string, gain int, bad boolean, t int, id int")
    rows = {r.k: r for r in summarised(f, ["k"], "tag", "gain", "bad", "t", "id", 2).collect()}
    assert (rows[0].calibration, rows[0].mixed, rows[0].gains, rows[0].unknown, rows[0].suspects) == (None, False, "7:1", 1, 1)
    assert (rows[1].calibration, rows[1].mixed, rows[1].gains, rows[1].first_us, rows[1].last_us) == ("a", True, "1:2", 3, 4)
    seven = spark.range(7)
    assert [(r.id, r.next_cursor) for r in paged(seven, ["id"], 4, 2).collect()] == [(4, 6), (5, 6)]
    assert [(r.id, r.next_cursor) for r in paged(seven, ["id"], 6, 2).collect()] == [(6, None)] and paged(seven, ["id"], 9, 2).count() == 0
