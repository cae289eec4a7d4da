"""Features, evidence, windows, rankings and labels on small rows of their own, odd values among them."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from spectraloom.functions import labels as L
from spectraloom.operators import attention as A


def test_features_of_odd_observations(spark):
    shape = "e string, name string, value double, sigma double, label string, suspect boolean"
    rows = [("a", "f", 1.0, 0.5, None, False), ("a", "f", 3.0, None, None, None), ("a", "f", 900.0, 1.0, None, True), ("a", "c", None, None, "x", False), ("a", "c", None, None, "y", False), (None, "f", None, None, None, True), ("b", "f", 7.0, 2.0, None, False)]
    got = {(r.e, r.name): tuple(r)[2:] for r in A.emission_features(spark.createDataFrame(rows, shape), ["e"], "name", "value", "sigma", "label", "suspect").collect()}
    assert got["a", "f"] == (2, 1, 2.0, pytest.approx(math.sqrt(2 + 0.125)), 1.0, 3.0, None)
    assert got["a", "c"] == (2, 0, None, None, None, None, "x") and got[None, "f"][:3] == (0, 1, None) and got["b", "f"][3] == 2.0


def test_evidence_of_groups(spark):
    rows = [("a", None, 2.0), ("a", None, 3.0), ("a", "g", 5.0), ("a", "g", 1.0), ("a", "h", float("inf")), ("b", "g", None)]
    got = {r.k: tuple(r)[1:] for r in A.accumulated_evidence(spark.createDataFrame(rows, "k string, g string, b double"), ["k"], "g", "b").collect()}
    assert got["a"] == (10.0, 4, 3) and got.get("b", (0.0, 0, 0)) == (0.0, 0, 0)


def brute_windows(items, usable, quantum, guard):
    left, out = sorted(items), []
    half = usable / 2
    fits = lambda i, c: i[1] >= c - half and i[2] <= c + half and (i[1] >= c + guard or i[2] <= c - guard)
    while left:
        lead = left[0]
        grid = [k * quantum for k in range(-4000, 4000) if fits(lead, k * quantum)]
        if grid:
            centre = max(grid, key=lambda c: (math.fsum(i[3] for i in left[1:] if fits(i, c)), -c))
            members = [lead] + [i for i in left[1:] if fits(i, centre)]
        else:
            centre, members = (lead[1] + lead[2]) / 2, [lead]
        out += [(len({o[0] for o in out}), centre, i[0]) for i in members] if not out else [(out[-1][0] + 1, centre, i[0]) for i in members]
        left = [i for i in left if i not in members]
    return out


def test_windows_equal_brute_force():
    rng = random.Random(2)
    for _ in range(40):
        items = []
        for rank in range(rng.randrange(1, 12)):
            lo = rng.randrange(0, 240) / 8
            items.append((rank, lo, lo + rng.choice([0.25, 1.0, 3.0, 12.0]), rng.randrange(1, 9) / 4))
        fold = A.WindowFold(10.0, 0.25, 0.5)
        state = fold.start()
        for i in items:
            fold.step(state, i)
        got = list(fold.end(state))
        assert [g[:3] for g in got] == brute_windows(items, 10.0, 0.25, 0.5)
        assert all(g[4] == (items[g[2]][2] - items[g[2]][1] > 4.5) for g in got if g[3])
    assert list(A.WindowFold(10.0, 0.25, 0.5).end([])) == []


def plain_rankings(rows, every, most, moved):
    """Looks at every row and every due time, the scores as they were."""
    out, version, given, run = [], 0, None, None
    scores = {}

    def look(t):
        nonlocal version, given, run
        run = t
        top = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:most]
        if given is None or [s for s, _ in top] != [s for s, _ in given] or any(abs(a - b) >= moved and a != b for (_, a), (_, b) in zip(top, given, strict=True)):
            version, given = version + 1, top
            out.extend((version, t, k + 1, s, x) for k, (s, x) in enumerate(top))

    for t, subject, score in rows:
        if run is not None and t - run >= every:
            look(run + every)
        scores.pop(subject, None)
        if score is not None:
            scores[subject] = score
        if run is None or t - run >= every:
            look(t)
    return out


def test_rankings_are_published_when_they_change(spark):
    rng = random.Random(3)
    rows = [(t, rng.randrange(6), rng.choice([None, float(rng.randrange(5))])) for t in sorted(rng.sample(range(1000), 150))]
    df = spark.createDataFrame([("s", *r) for r in rows], "site string, t_us long, subject long, score double")
    for every, most, moved in itertools.product((1, 50), (2, 10), (0.0, 2.0)):
        got = sorted(tuple(r)[1:] for r in A.published(df, ["site"], every, most, moved).collect())
        assert got == sorted(plain_rankings(rows, every, most, moved))
    fold = A.PublisherFold(10)
    state = fold.start()
    assert fold.step(state, (0, 1, 5.0)) == [(1, 0, 1, 1, 5.0)] and fold.step(state, (20, 1, 5.0)) == [] and fold.step(state, (40, 1, None)) == []


def test_pages_by_key_hold_every_row_once(spark):
    rows = [(k // 3, k, "x") for k in range(20)]
    df = spark.createDataFrame(rows, "t long, i long, v string").repartition(3)
    got, after = [], None
    while (page := A.page_after(df, ["t", "i"], after, 6).collect()):
        got += [tuple(r) for r in page]
        after = (page[-1].t, page[-1].i)
    assert got == rows and A.last_key(df.where("i < 0"), ["t", "i"]) is None and A.last_key(df, ["t", "i"]) == (6, 19)


def test_labels_and_characters(spark):
    df = spark.createDataFrame([(" WFM", bytes([72, 105, 0, 127, 233])), ("ASK", b""), ("fm", None), (None, b"\x1f"), ("unknown", b"\xa0")], "l string, b binary")
    got = df.select(L.family_of(F.col("l")).alias("f"), L.branch_of(F.col("l")).alias("br"), L.characters(F.col("b"), "ascii").alias("a"), L.characters(F.col("b"), "latin1").alias("t"), L.characters(F.col("b"), "pager").alias("p")).collect()
    assert [(r.f, r.br) for r in got] == [("analog", "analog"), ("ook-ask", "digital"), (None, None), (None, None), ("unknown", "unknown")]
    assert [r.a for r in got] == ["Hi\\x00\\x7f\\xe9", "", None, "\\x1f", "\\xa0"]
    assert [r.t for r in got] == ["Hi\\x00\\x7fé", "", None, "\\x1f", " "] and [r.p for r in got] == ["890(9", "", None, "(", "0"]


def test_noise_of_quantisation_and_clock_errors(spark):
    assert L.quantisation_noise_dbfs() == pytest.approx(-49.93, abs=0.01) and L.quantisation_noise_dbfs(12) == pytest.approx(L.quantisation_noise_dbfs() - 24.08, abs=0.01)
    df = spark.createDataFrame([(100.001, 0.0005, 100.0), (5.0, 1.0, 0.0), (None, 1.0, 5.0)], "m double, s double, n double")
    got = [r.p for r in df.select(L.ppm_from_line(F.col("m"), F.col("s"), F.col("n")).alias("p")).collect()]
    assert (got[0].ppm, got[0].sigma) == (pytest.approx(10), pytest.approx(5)) and got[1:] == [None, None]
    assert df.select(L.corrected(F.lit(100.001), F.lit(10.0))).first()[0] == pytest.approx(100.0)


def test_a_row_replaces_one_score_and_no_other():
    fold = A.PublisherFold(1000, 2)
    state = fold.start()
    fold.step(state, (0, 7, 1.0))
    held = state["scores"]
    for k in range(100):
        fold.step(state, (1 + k, k, float(k)))
    assert state["scores"] is held and len(held) == 100  # the table of scores isn't made anew by each row
    assert fold.step(state, (1000, 99, None)) == [(2, 1000, 1, 99, 99.0), (2, 1000, 2, 98, 98.0)] and len(held) == 99


def test_levels_are_compared_as_sql_does(spark, tmp_path):
    import datetime

    import duckdb

    from spectraloom.plans import ORACLE_SQL, QUERIES

    rows = [("view", 1.5, 3), ("view", 0.0, 3), ("view", 2.0, 3), ("view", 0.0, None), ("view", 0.0, 4), (None, -1.0, 44), ("click", None, 45), ("click", 7.0, 46), ("view", 7.0, 46)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(minutes=i), 1, t, x, "{}" if k is None else f'{{"k": {k}}}') for i, (t, x, k) in enumerate(rows)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["level_comparisons"](spark, str(tmp_path))
    want = duck.sql(ORACLE_SQL["level_comparisons"]).select(*got.columns).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert any(repr(r).count("inf") for r in want)


def test_levels_are_rounded_as_sql_does(spark, tmp_path):
    import datetime
    import random

    import duckdb

    from spectraloom.plans import ORACLE_SQL, QUERIES

    draw = random.Random(4)
    pairs = [(0.01, draw.uniform(1e5, 1e7)) for _ in range(3000)]  # far apart: a thousandth is near the last bit that counts
    pairs += [(10.24, draw.randrange(1, 20000) / 100) for _ in range(200)] + [(1.0, 1 - 1e-12), (-0.0, 2.0), (0.0, -2.0), (1e-300, 1e12), (1e-12, 5.0)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(2 * i + j, at + datetime.timedelta(minutes=j), i, "view", x, f'{{"k": {-5 if j else 5}}}') for i, pair in enumerate(pairs) for j, x in enumerate(pair)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    got = QUERIES["level_comparisons"](spark, str(tmp_path))
    want = duck.sql(ORACLE_SQL["level_comparisons"]).select(*got.columns).fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
