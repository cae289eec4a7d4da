import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spectraloom.functions import scalar as S
from spectraloom.operators import aggregates as A
from spectraloom.operators import frames as B
from spectraloom.operators import graph as G
from spectraloom.operators import intervals as I
from spectraloom.operators import joins as J
from spectraloom.operators import relations as R
from spectraloom.operators import sequences as Q
from spectraloom.operators import spectral as X


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def random_intervals(seed, n=300):
    rng = random.Random(seed)
    return [(rng.randrange(4), a, a + rng.randrange(0, 30)) for a in (rng.randrange(1000) for _ in range(n))]


def brute_merge(items, strict):
    out = []
    for k in sorted({k for k, _, _ in items}):
        cur = None
        for lo, hi in sorted((lo, hi) for q, lo, hi in items if q == k):
            if cur and (lo < cur[1] if strict else lo <= cur[1]):
                cur = (cur[0], max(cur[1], hi), cur[2] + 1)
            else:
                if cur:
                    out.append((k, *cur))
                cur = (lo, hi, 1)
        out.append((k, *cur))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [None, 7, 100, 10_000])
def test_merge_by_blocks(spark, block):
    items = random_intervals(block or 1)
    df = spark.createDataFrame(items, "k int, lo long, hi long")
    assert rows(I.merge(df, ["k"], "lo", "hi", block)) == brute_merge(items, False)


def test_merge_strict_leaves_touching_apart(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 9), (1, 8, 12), (1, None, 3)], "k int, lo long, hi long")
    assert rows(I.merge(df, ["k"], "lo", "hi", strict=True)) == [(1, 0, 5, 1), (1, 5, 12, 2)]
    assert rows(I.merge(df, ["k"], "lo", "hi")) == [(1, 0, 12, 3)]


def test_gaps_fill_what_merged_leaves(spark):
    items = [x for x in random_intervals(9) if x[1] < x[2]]
    df = I.merge(spark.createDataFrame(items, "k int, lo long, hi long"), ["k"], "lo", "hi", 50)
    got = rows(I.gaps(df, ["k"], "lo", "hi", 100, 900))
    want = []
    for k in range(4):
        covered = {x for q, lo, hi in items if q == k for x in range(max(lo, 100), min(hi, 900))}
        free = [x for x in range(100, 900) if x not in covered]
        starts = [x for x in free if x - 1 not in free]
        for s in starts:
            e = s
            while e in set(free):
                e += 1
            want.append((k, s, e))
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("contains", [False, True])
def test_range_join_equals_naive(spark, contains):
    a, b = random_intervals(4, 120), random_intervals(5, 120)
    left = spark.createDataFrame([(i, *x) for i, x in enumerate(a)], "i int, k int, lo long, hi long")
    right = spark.createDataFrame([(j, *x) for j, x in enumerate(b)], "j int, q int, lo2 long, hi2 long")
    got = rows(I.range_join(left, right, [("k", "q")], ("lo", "lo2"), ("hi", "hi2"), 16, contains).select("i", "j"))
    meets = lambda x, y: x[0] == y[0] and ((y[1] <= x[1] and x[2] <= y[2]) if contains else (x[1] <= y[2] and x[2] >= y[1]))
    assert got == sorted(((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if meets(x, y)), key=str)


def test_subtract(spark):
    df = spark.createDataFrame([(0, 10, 3, 5), (0, 10, -5, 2), (0, 10, 8, 20), (0, 10, None, None), (0, 10, -1, 11), (0, 10, 10, 12)], "lo int, hi int, c int, d int")
    assert rows(I.subtract(df, "lo", "hi", "c", "d").select("lo", "hi")) == sorted([(0, 3), (5, 10), (2, 10), (0, 8), (0, 10), (0, 10)], key=str)


def test_scalars(spark):
    v = lambda c: value(spark, c)
    assert v(S.hour_of_week(F.lit(4 * 86_400_000_000))) == 0 and v(S.hour_of_week(F.lit(0))) == 72 and v(S.hour_of_week(F.lit(-1))) == 71
    assert v(S.to_db(F.lit(0.0))) == -300 and math.isclose(v(S.from_db(F.lit(20.0))), 100)
    assert v(S.novelty_of_z(F.lit(float("nan")))) == 0 and v(S.novelty_of_z(F.lit(6.5))) == 0.5
    k, mu = 7, 2.5
    tail = 1 - sum(math.exp(-mu) * mu**i / math.factorial(i) for i in range(k))
    assert math.isclose(v(S.novelty_of_new(F.lit(k), F.lit(mu))), -math.log10(tail) / 6, rel_tol=1e-9)
    assert v(S.novelty_of_new(F.lit(0), F.lit(mu))) == 0 and v(S.novelty_of_new(F.lit(500), F.lit(1.0))) == 1
    w = v(S.wilson(F.lit(0.0), F.lit(10.0)))
    assert w.lo == 0 and math.isclose(w.hi, 0.2775, abs_tol=1e-3) and v(S.wilson(F.lit(0.5), F.lit(0.5))) is None
    assert v(S.ucb_index(F.lit(1.0), F.lit(10.0), F.lit(0.0), 1.0)) == float("inf")
    assert math.isclose(v(S.great_circle_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(90.0))), math.pi * 6371 / 2, rel_tol=1e-12)
    box = lambda lat, lon: v(S.box_distance_km(F.lit(lat), F.lit(lon), F.lit(-10.0), F.lit(170.0), F.lit(10.0), F.lit(-170.0)))
    assert box(0.0, 179.0) == 0 and box(0.0, -175.0) == 0 and math.isclose(box(0.0, 160.0), 10 * math.pi * 6371 / 180, rel_tol=1e-9)
    e = v(S.eccentric_anomaly(F.lit(1.0), F.lit(0.3)))
    assert math.isclose(e - 0.3 * math.sin(e), 1.0, abs_tol=1e-12)
    assert math.isclose(v(S.entropy(F.array(*[F.lit(0.25)] * 4))), 1) and v(S.entropy(F.array(F.lit(1.0)))) == 0
    assert v(S.timing(F.lit(None).cast("double"), F.lit(1.0))) == "unknown" and v(S.timing(F.lit(1.0), F.lit(2.0))) == "complete"
    t = v(S.occupancy_threshold(F.lit(-100.0), F.lit(6.0), F.lit(100e3), F.lit(10e3)))
    assert t.threshold_db == -97 and t.clamped
    assert v(S.interestingness(F.lit(40.0), F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0), F.lit(0.0))) == 1


def test_slots_merge_like_one_fold(spark):
    rng = random.Random(2)
    df = spark.createDataFrame([(i % 3, rng.gauss(0, 5), rng.random() + 0.1) for i in range(200)], "k int, x double, w double").withColumn("part", F.pmod(F.hash("x"), F.lit(5)))
    whole = A.slot_measures(A.slot_sums(df, ["k"], "x", "w", F.col("x") > 0, F.lit(2.0))).orderBy("k").toPandas()
    parts = A.slot_sums(df, ["k", "part"], "x", "w", F.col("x") > 0, F.lit(2.0)).drop("part")
    merged = A.slot_measures(A.merge_slots(parts, ["k"])).orderBy("k").toPandas()
    for c in ("n_visits", "mean_db", "std_db", "fco", "fco_var_s", "max_db"):
        assert np.allclose(whole[c], merged[c])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(0, 1), max_size=60))
def test_hysteresis_in_pieces_is_hysteresis(scores):
    times = list(range(len(scores)))
    whole, _ = Q.hysteresis_steps(scores, times)
    state, out = (False, 0, 0, -1), []
    for i in range(0, len(scores), 7):
        steps, state = Q.hysteresis_steps(scores[i : i + 7], times[i : i + 7], state)
        out += steps
    assert out == whole


def test_hysteresis_raises_clears_and_reopens():
    steps, _ = Q.hysteresis_steps([0.9, 0.9, 0.5, 0.1, 0.1, 0.1, 0.8, 0.8, 0.1, 0.1, 0.5, 0.1], list(range(12)))
    assert steps == ["quiet", "raise", "hold", "hold", "hold", "clear", "quiet", "reopen", "hold", "hold", "hold", "hold"]


def test_period_fold_finds_a_lattice():
    rng = np.random.default_rng(0)
    t = (np.arange(0, 60, 2.5) + rng.normal(0, 0.01, 24))[rng.random(24) > 0.2]
    period, jitter, share = Q.fold_period(t)
    assert abs(period - 2.5) < 0.01 and jitter < 0.05 and share > 0.6
    assert Q.fold_period(np.array([1.0, 2.0])) == (0.0, 0.0, 0.0)


def test_runs_and_fill(spark):
    df = spark.createDataFrame([(1, t, s) for t, s in enumerate("aabbba")] + [(2, 0, None), (2, 1, None), (2, 2, "x")], "k int, t int, s string").withColumn("tie", F.lit(0))
    assert rows(Q.runs(df, ["k"], "t", "tie", "s")) == sorted([(1, "a", 0, 1, 2), (1, "b", 2, 4, 3), (1, "a", 5, 5, 1), (2, None, 0, 1, 2), (2, "x", 2, 2, 1)], key=str)
    gaps = spark.createDataFrame([(1, 0, None), (1, 1, 2.0), (1, 2, None), (1, 4, 8.0), (1, 5, None)], "k int, x int, y double")
    assert [r.filled for r in Q.fill_gaps(gaps, ["k"], "x", "y").orderBy("x").collect()] == [2, 2, 4, 8, 8]


def test_chains_of_merges(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 101)], "child long, parent long")
    assert {(r.child, r.root) for r in J.follow_merges(links, "child", "parent").collect()} == {(i, 37) for i in range(37)} | {(100, 101)}


def test_greedy_matching_equals_one_pass(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(30), rng.randrange(30), rng.randrange(50)) for _ in range(200)]
    pairs = list({(a, b): (a, b, c) for a, b, c in pairs}.values())
    used_a, used_b, want = set(), set(), []
    for c, a, b in sorted((c, a, b) for a, b, c in pairs):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), want.append((a, b, c))
    assert rows(J.greedy_one_to_one(spark.createDataFrame(pairs, "a int, b int, c int"), "a", "b", "c")) == sorted(want, key=str)


def test_as_of_takes_rows_at_the_same_time(spark):
    left = spark.createDataFrame([(1, 5, 0), (1, 10, 1), (1, 1, 2), (2, 5, 3)], "k int, t int, i int")
    right = spark.createDataFrame([(1, 5, "a"), (1, 7, "b"), (2, 6, "c")], "k int, t int, v string")
    assert {r.i: r.v for r in J.as_of(left, right, "k", "t", "v", "i").collect()} == {0: "a", 1: "b", 2: None, 3: None}


def test_upsert(spark):
    old = spark.createDataFrame([(1, 5, 9, "o"), (2, 1, 2, "o")], "k int, f int, l int, v string")
    new = spark.createDataFrame([(1, 3, 9, "n"), (3, 7, 7, "n")], "k int, f int, l int, v string")
    assert rows(J.upsert(old, new, ["k"], "f", "l", ["v"])) == [(1, 3, 9, "n"), (2, 1, 2, "o"), (3, 7, 7, "n")]


def test_grid_labels(spark):
    picture = ["##..#", "#...#", "..#..", "#.##."]
    cells = [(x, y) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"]
    got = {(r.x, r.y): r.label for r in G.label_cells(spark.createDataFrame(cells, "x long, y long"), "x", "y", 5).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (0, 1): 0, (4, 0): 4, (4, 1): 4, (2, 2): 12, (2, 3): 12, (3, 3): 12, (0, 3): 15}


def test_spectral(spark):
    n = 64
    tone = [math.cos(2 * math.pi * 4 * i / 16) for i in range(n)]
    df = spark.createDataFrame([(tone, tone[3:] + tone[:3])], "a array<double>, b array<double>")
    psd = df.select(X.welch(16)("a").alias("p")).first().p
    assert int(np.argmax(psd)) in (4, 12) and math.isclose(psd[4], psd[12])
    noise = np.random.default_rng(1).normal(size=256).tolist()
    pair = spark.createDataFrame([(noise, noise[5:] + [0.0] * 5)], "a array<double>, b array<double>")
    lag = pair.select(X.best_lag(8)("a", "b").alias("r")).first().r
    assert lag.lag == 5 and lag.correlation > 0.9
    figures = X.taper_figures(X.taper("hann", 64))
    assert math.isclose(figures["enbw"], 1.5) and math.isclose(figures["gain"], 0.5)
    taps = X.kaiser_lowpass(63, 0.1, 60)
    response = np.abs(np.fft.rfft(taps, 1024))
    assert abs(response[0] - 1) < 1e-9 and response[int(0.2 * 1024) :].max() < 2e-3
    floor = spark.createDataFrame([([1.0] * 50 + [100.0] * 5,)], "p array<double>").select(X.noise_floor_fcme()("p").alias("f")).first().f
    assert floor == 1
    iq = np.exp(2j * np.pi * 0.1 * np.arange(50))
    step = spark.createDataFrame([(np.stack([iq.real, iq.imag], 1).ravel().tolist(),)], "x array<double>").select(X.demodulate_fm()("x").alias("d")).first().d
    assert np.allclose(step, 0.1)
    flat = spark.createDataFrame([([2.0] * 10,)], "p array<double>").select(X.kurtosis_of_power(F.col("p")).alias("k")).first().k
    assert abs(flat) < 1e-9


def test_frames(spark):
    raw = bytes.fromhex("1acffc1d0badc0de") + b"123456789"
    df = spark.createDataFrame([(raw, "123456789", [1, 0, 0, 1, 1, 1, 0, 0])], "raw binary, s string, b array<int>")
    check = b"123456789"
    checks = spark.createDataFrame([(bytearray(check),)], "raw binary")
    #: Check values of the models for these nine digits, as published in CRC catalogues. Fixed values.
    for model, want in (("crc16-ccitt-false", 0x29B1), ("crc16-x25", 0x906E), ("crc16-arc", 0xBB3D), ("crc8", 0xF4), ("crc32", 0xCBF43926)):
        assert checks.select(B.crc(model)("raw").alias("c")).first().c == want
    f = df.select(B.parse_fields(F.col("raw"), [("a", 0, 4), ("b", 4, 8), ("c", 32, 16), ("far", 200, 8)]).alias("f")).first().f
    assert (f.a, f.b, f.c, f.far) == (1, 0xAC, 0x0BAD, None)
    assert df.select(B.find_sync(F.col("raw"), 0x1ACFFC1D, 4, 0).alias("x")).first().x == [0]
    assert df.select(B.find_sync(F.col("raw"), 0x0BADC0DF, 4, 1).alias("x")).first().x == [4]
    assert df.select(B.add_checksum(B.byte_values(F.col("s"))).alias("x")).first().x == sum(check) % 256
    r = df.select(B.differential(F.col("b")).alias("d"), B.nrzi(F.col("b")).alias("n"), B.manchester(F.col("b")).alias("m"), B.unstuff(F.lit("0111110111110")).alias("u"), B.parity(F.lit(7)).alias("p")).first()
    assert r.d == [1, 0, 1, 0, 0, 1, 0] and r.n == [0, 1, 0, 1, 1, 0, 1] and r.m == [1, 0, None, None] and r.u == "01111111111" and r.p == 1
    tree = {"all": [{"field": "a", "op": "gt", "value": 1}, {"not": {"any": [{"field": "a", "op": "eq", "value": 3}, {"field": "a", "op": "one_of", "value": [5, 6]}]}}]}
    assert [x.a for x in spark.range(8).select(F.col("id").alias("a")).where(B.condition(tree)).orderBy("a").collect()] == [2, 4, 7]


def test_retune_claims(spark):
    lo = np.repeat([10.0, 11.0, 12.0, 13.0], 3)
    centres = np.where(np.arange(12) % 3 == 0, 100.0, np.where(np.arange(12) % 3 == 1, 50 + lo, 30 + 2 * lo))
    claimed = R.retune_groups(centres, lo, 0.1, 3)
    assert claimed.tolist() == [0, 1, 2] * 4


def test_harmonic_line(spark):
    df = spark.createDataFrame([(1, n, 7.0 + 2.5 * n) for n in range(1, 6)], "k int, n int, f double")
    r = R.harmonic_line(df, ["k"], "n", "f").first()
    assert math.isclose(r.spacing, 2.5) and math.isclose(r["offset"], 7.0) and r.sigma < 1e-6


def test_cluster_distance(spark):
    z = lambda *x: [F.lit(v).cast("double") for v in x]
    assert value(spark, J.cluster_distance(z(1.0, 1.0, None))) is None
    assert value(spark, J.cluster_distance(z(1.0, 1.0, 4.0))) == float("inf")
    assert value(spark, J.cluster_distance(z(1.0, 1.0, 1.0, None))) == 1



def test_density_clusters_equal_brute_force(spark):
    from spectraloom.operators import clusters as C

    rng = random.Random(4)
    points = [(i, rng.gauss(c * 10, 1.2), rng.gauss(c * 5, 1.2)) for i, c in enumerate([0] * 30 + [1] * 30 + [2] * 8)] + [(100, 200.0, 200.0)]
    got = {r.i: r.cluster for r in C.density_clusters(spark.createDataFrame(points, "i long, x double, y double"), "i", "x", "y", 1.0, 4).collect()}
    near = {a: [b for b, u, v in points if (x - u) ** 2 + (y - v) ** 2 <= 1] for a, x, y in points}
    cores = {a for a in near if len(near[a]) >= 4}
    want, seen = {}, {}
    for a in sorted(cores):
        if a not in seen:
            todo = [a]
            while todo:
                b = todo.pop()
                if b not in seen:
                    seen[b] = a
                    todo += [c for c in near[b] if c in cores]
    for a in near:
        want[a] = seen[a] if a in cores else min((seen[b] for b in near[a] if b in cores), default=None)
    assert got == want


def test_density_clusters_of_copies_lines_and_odd_places(spark):
    from spectraloom.operators import clusters as C

    rng = random.Random(5)
    points = [(rng.choice([0.0, 0.9, 1.8, 2.7]), rng.randrange(60) / 7) for _ in range(150)] + [(5 + k / 4, 3.0) for k in range(20)] + [(10.7 + k / 4, 3.5) for k in range(9)] + [(rng.random() * 12, 9 + rng.random() * 4) for _ in range(90)]
    points += [(30.0, 30.0)] * 5 + [(30.0, 31.0), (31.0, 31.0), (-0.0, -5.0), (0.0, -5.0)] + [(float("nan"), 0.0), (float("inf"), 0.0), (None, 0.0)]
    points = [(i, *p) for i, p in enumerate(rng.sample(points, len(points)))]
    for least in (1, 3, 5):
        df = spark.createDataFrame(points, "i long, x double, y double")
        got = {r.i: r.cluster for r in C.density_clusters(df, "i", "x", "y", 1.0, least).collect()}
        near = {a: [b for b, u, v in points if None not in (x, u) and (x - u) * (x - u) + (y - v) * (y - v) <= 1] for a, x, y in points}
        cores = {a for a in near if len(near[a]) >= least}
        root = {a: a for a in cores}
        while any(root[b] < root[a] for a in cores for b in near[a] if b in cores):
            root = {a: min(root[b] for b in near[a] if b in cores) for a in cores}
        assert got == {a: root[a] if a in cores else min((root[b] for b in near[a] if b in cores), default=None) for a in near}, least


def test_density_clusters_of_crowds_make_no_pairs(spark):
    from spectraloom.operators import clusters as C

    crowd = spark.range(120_000).selectExpr("id as i", "cast(id % 2 * 1.5 + (id * 7919 % 60000) / 120000 as double) as x", "cast((id * 104729 % 60000) / 120000 as double) as y")  # 3.6e9 pairs in each
    got = C.density_clusters(crowd, "i", "x", "y", 1.0, 4).groupBy("cluster").count().collect()
    assert sorted((r["cluster"], r["count"]) for r in got) == [(0, 60_000), (1, 60_000)]


def test_distinct_pairs_hold_no_pair_that_cannot_repeat(spark):
    from spectraloom.operators import relations as R

    rng = random.Random(8)
    left = [(rng.randrange(12), rng.choice([0, 1, 2, None]), rng.randrange(3)) for _ in range(25)] + [(100 + k, 0, 0) for k in range(5)]
    right = [(rng.randrange(12), rng.choice([0, 1, 2, None]), rng.randrange(3)) for _ in range(25)] + [(200 + k, 0, 0) for k in range(5)]
    got = R.distinct_pairs(spark.createDataFrame(left, "a long, k long, q long"), spark.createDataFrame(right, "b long, k long, q long"), "a", "b", ["k", "q"])
    want = {(a, b) for a, k, q in left for b, l, r in right if k is not None and (k, q) == (l, r)}
    assert sorted(map(tuple, got.collect())) == sorted(want)
    many = spark.range(3000).selectExpr("id as a", "0 as k"), spark.range(20_000).selectExpr("id as b", "0 as k")
    assert R.distinct_pairs(*many, "a", "b", ["k"]).groupBy().agg({"*": "count"}).first()[0] == 60_000_000


def test_frame_inference(spark):
    frames = spark.createDataFrame([(1, bytearray(b"abcXab")), (2, bytearray(b"abcYcd")), (3, bytearray(b"a"))], "i int, raw binary")
    words = {bytes.fromhex(r.word): (r.frames, r.places) for r in B.word_hunt(frames, "i", "raw", 2).collect()}
    assert words[b"ab"] == (2, 3) and words[b"bc"] == (2, 2) and words[b"cd"] == (1, 1) and len(words) == 7
    entropy = {r.at: r.entropy for r in B.place_entropy(frames, "raw", 6).collect()}
    assert entropy[0] == 0 and entropy[3] == 1
    x = spark.createDataFrame([(list(range(6)), [1, 0, 1, 1, 0, 0, 1])], "a array<int>, b array<int>")
    written = [[0, 1, 2], [3, 4, 5]]
    read = [written[r][c] for c in range(3) for r in range(2)]
    row = spark.createDataFrame([(read,)], "a array<int>").select(B.deinterleave(F.col("a"), 2, 3).alias("x")).first()
    assert row.x == list(range(6))
    bits = [1, 0, 1, 1, 0, 0, 1]
    want = [bits[i] ^ (bits[i - 2] if i >= 2 else 0) for i in range(7)]
    assert x.select(B.descramble(F.col("b"), [2]).alias("x")).first().x == want


def test_codes(spark):
    from spectraloom.operators import codes

    rng = random.Random(6)
    sent, got = [], []
    for errors in [0, 1, 2] * 8:
        data = rng.getrandbits(21) << 10
        word = data | codes.remainder(data)
        assert codes.remainder(word) == 0
        sent.append((word, errors))
        got.append((word ^ sum(1 << p for p in rng.sample(range(31), errors)),))
    out = spark.createDataFrame(got, "w long").coalesce(1).select(codes.correct_blocks()("w").alias("r")).collect()
    assert [(r.r.word, r.r.errors) for r in out] == sent
    messages = [[rng.randrange(2) for _ in range(40)] for _ in range(6)]
    coded = [codes.convolve_bits(m) for m in messages]
    for c in coded:
        for at in range(5, len(c), 23):
            c[at] ^= 1
    out = spark.createDataFrame([(c,) for c in coded], "c array<int>").coalesce(1).select(codes.decode_convolution()("c").alias("m")).collect()
    assert [r.m for r in out] == messages


def test_channeliser_and_clipping(spark):
    n, channels = 2048, 8
    z = np.exp(2j * np.pi * (2 / channels) * np.arange(n))
    block = np.stack([z.real, z.imag], 1).ravel().tolist()
    p = spark.createDataFrame([(block,)], "x array<double>").select(X.channelise(channels)("x").alias("p")).first().p
    assert int(np.argmax(p)) == channels // 2 + 2 and p[channels // 2 + 2] > 1e4 * np.delete(p, channels // 2 + 2).max()
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate([0, 5, 5, 0, 5, 0, 0, 5])], "k int, t int, c int")
    assert [r.overload for r in X.overloaded(df, ["k"], "t", "c", 3, 3, 2).orderBy("t").collect()] == [False, False, True, False, True, False, False, False]


def test_radiometry(spark):
    v = lambda c: value(spark, c)
    assert math.isclose(v(S.above_kt0(F.lit(-113.975), F.lit(1e6))), 0, abs_tol=1e-9) and math.isclose(v(S.noise_temperature(F.lit(10 * math.log10(2)))), 290)
    assert v(S.root_sum_square(F.lit(3.0), F.lit(4.0))) == 5 and math.isclose(v(S.median_external_noise(76.8, 27.7, F.lit(10.0))), 49.1)


def test_merges_of_any_length_and_circles(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1500)] + [(5, 6), (None, 7), (7, None)], "child long, parent long")
    out = J.follow_merges(links, "child", "parent").collect()
    assert len(out) == 1500 and {r.root for r in out} == {1500}
    for circle in ([(1, 2), (2, 3), (3, 1)], [(4, 4)], [(1, 2), (2, 3), (3, 4), (4, 2)]):
        with pytest.raises(ValueError, match="circle"):
            J.follow_merges(spark.createDataFrame(circle, "child long, parent long"), "child", "parent")


def test_allocations_keep_repeated_rows(spark):
    from spectraloom.operators import relations as R

    a = spark.createDataFrame([(0.0, 10.0, "low", 1), (5.0, 20.0, "wide", 1), (6.0, 7.0, "best", 2), (6.0, 7.0, "other", 0)], "lo double, hi double, service string, status int")
    df = spark.createDataFrame([(1, 6.5), (1, 6.5), (2, 5.0), (3, 20.0), (4, None)], "i int, x double")
    out = sorted((r.i, str(r.service)) for r in R.allocated(df, "x", a, "lo", "hi", "status").collect())
    assert out == [(1, "best"), (1, "best"), (2, "wide"), (3, "None"), (4, "None")]
    assert {r.service for r in R.allocated(df, "x", a.where("false"), "lo", "hi", "status").collect()} == {None}


def test_totals_name_channels_without_visits(spark):
    v = spark.createDataFrame([("a", "t", 10, 20), ("a", "u", 15, 30), ("b", "t", 500, 600), ("c", "u", 90, 120)], "k string, tier string, lo long, hi long")
    out = {r.k: r for r in I.totals(v, ["k"], "lo", "hi", "tier", ["t", "u"], 0, 100, 1000, ["u"]).collect()}
    assert (out["a"].n_visits, out["a"].n_independent, out["a"].t_us, out["a"].u_us, out["a"].longest_gap_us) == (1, 1, 10, 15, 70)
    assert (out["b"].n_visits, out["b"].n_independent, out["b"].t_us, out["b"].mean_revisit_us, out["b"].longest_gap_us) == (0, 0, 0, None, 100)
    assert (out["c"].u_us, out["c"].longest_gap_us) == (10, 90)


def test_fusion_of_evidence_and_prior(spark):
    from spectraloom.operators import clusters as C

    def run(rows, open_set=0.0):
        df = spark.createDataFrame([(1, c, float(x), float(p), open_set) for c, x, p in rows], "k int, c string, l double, p double, o double")
        out = C.fused(df, "k", "c", "l", "p", "o").collect()
        assert abs(sum(r.posterior for r in out) - 1) < 1e-12
        return {r.c: r.posterior for r in out}, out[0].exponent

    post, tau = run([("a", 0.6, 1), ("b", 0.3, 1), ("unknown", 0.1, 5)])
    assert tau == 1 and abs(post["a"] - 0.6) < 1e-12 and abs(post["unknown"] - 0.1) < 1e-12
    post, tau = run([("a", 0.5, 1), ("b", 0.5, 3), ("unknown", 0, 0)], 0.4)  # a tie that the prior breaks
    assert tau == 1 and abs(post["b"] - 0.45) < 1e-12 and abs(post["unknown"] - 0.4) < 1e-12
    post, tau = run([("a", 0.9, 1), ("b", 0.05, 1000), ("unknown", 0.05, 0)])  # dominant evidence is not overturned
    assert 0 < tau < 1 and abs(1000**tau * 0.05 - 0.9) < 1e-6 and abs(post["a"] - post["b"]) < 1e-6
    post, _ = run([("a", 0, 1), ("b", 0, 9), ("unknown", 1, 0)], 1.0)
    assert abs(post["unknown"] - 0.9) < 1e-12 and abs(post["a"] - 0.05) < 1e-12
    post, _ = run([("a", 1, 1), ("b", 0, 1)])
    assert abs(post["a"] - 0.999) < 1e-12 and abs(post["b"] - 0.001) < 1e-12


def test_checks_of_ragged_frames_and_carries():
    import random
    import zlib

    rng = random.Random(8)
    frames = [rng.randbytes(rng.choice([0, 1, 2, 3, 17, 200])) for _ in range(300)]
    assert B.frame_checks(frames, "crc32").tolist() == [zlib.crc32(f) for f in frames]
    for model, (width, poly, init, reflected, final) in B.CRC_MODELS.items():

        def plain(frame):
            r = init
            for byte in frame:
                for bit in range(8):
                    top = (r >> (width - 1)) ^ (byte >> (bit if reflected else 7 - bit) & 1)
                    r = (r << 1 & (1 << width) - 1) ^ (poly if top & 1 else 0)
            return (int(f"{r:0{width}b}"[::-1], 2) if reflected else r) ^ final

        assert B.frame_checks(frames, model).tolist() == [plain(f) for f in frames], model
    assert B.frame_checks([], "crc8").tolist() == []


def test_ones_complement(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([255, 255],), ([200, 100],), ([],)], "v array<long>")
    assert [r.c for r in df.select(B.ones_complement(F.col("v")).alias("c")).collect()] == [249, 0, 255 - 45, 255]
