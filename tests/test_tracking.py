"""Tracks of bursts: what links, opens, merges, splits, hops and closes, in plain runs, in batches and in streams."""

import random

import pytest
from pyspark.sql import functions as F

from spectraloom.operators.tracking import DETECTION, EVENTS, BurstTracker, TrackRules, hop_sets, survivors, tracks
from spectraloom.streaming.carried import drained_carried

S = 1_000_000
NAMES = [c.split()[0] for c in EVENTS.split(", ")]


def told(rows, rules=None):
    """Events of boxes (start s, end s, centre, width); a centre of None: away."""
    tracker = BurstTracker(rules)
    boxes = [(int(e * S), int(s * S), k, c, w) for k, (s, e, c, w) in enumerate(rows)]
    state, out = tracker.start(), []
    for box in sorted(boxes, key=lambda b: b[:3]):
        out += tracker.step(state, box)
    return [dict(zip(NAMES, r, strict=True)) for r in out + tracker.end(state)]


def of(events, kind, *names):
    return [tuple(e[n] for n in names) for e in events if e["event"] == kind]


def test_near_bursts_are_one_track():
    events = told([(0, 1, 100.0, 4.0), (5, 6, 101.5, 4.0), (10, 11, 99.0, 5.0), (10, 11, 120.0, 4.0), (12, 13, 120.0, 9.0)])
    assert of(events, "link", "track", "detection", "n") == [(1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 3, 1), (3, 4, 1)]  # twice as wide and more: another
    assert of(events, "close", "track", "n", "on_us", "mean_gap_us") == [(1, 3, 3 * S, 5.0 * S), (2, 1, S, None), (3, 1, S, None)]


def test_nearest_wins_and_ties_go_to_the_older():
    rows = [(0, 1, 100.0, 4.0), (0, 1.1, 103.0, 4.0), (5, 6, 101.6, 4.0), (8, 9, 102.0, 4.0), (10, 11, 101.5, 4.0)]
    links = of(told(rows, TrackRules(merge_gates=0.0)), "link", "detection", "track")
    assert dict(links)[2] == 2 and dict(links)[0] == 1 and dict(links)[1] == 2


def test_overlapping_boxes_extend_a_burst():
    events = told([(0, 2, 50.0, 4.0), (1, 3, 50.0, 4.0), (3, 4, 50.5, 4.0), (9, 10, 50.0, 4.0)])
    assert of(events, "link", "detection", "n") == [(0, 1), (1, 1), (2, 1), (3, 2)]
    assert of(events, "close", "on_us", "n", "duty") == [(5 * S, 2, 0.5)]


def test_unconfirmed_tracks_are_dropped():
    assert told([(0, 0.01, 50.0, 4.0)]) == []
    assert of(told([(0, 0.01, 50.0, 4.0), (1, 1.01, 50.0, 4.0)]), "link", "track", "n") == [(1, 1), (1, 2)]


def test_silence_is_counted_in_observed_time():
    rules = TrackRules(idle_us=60 * S)
    assert of(told([(0, 1, 50.0, 4.0), (62, 63, 50.0, 4.0)], rules), "close", "track", "n") == [(1, 1), (2, 1)]
    assert of(told([(0, 1, 50.0, 4.0), (5, 30, None, None), (62, 63, 50.0, 4.0)], rules), "close", "track", "n") == [(1, 2)]
    steady = [(40 * k, 40 * k + 1, 50.0, 4.0) for k in range(4)] + [(120 + 150, 271, 50.0, 4.0)]
    assert of(told(steady, rules), "close", "n") == [(5,)]  # four of its own intervals are longer than the least


def test_tracks_that_converge_merge():
    rows = [(0, 1, 100.6, 4.0), (2, 3, 102.7, 4.0)]
    rows += [(4 + 2 * k, 5 + 2 * k, 100.6 if k % 3 == 0 else (101.9, 101.6, *[101.5] * 14)[k - k // 3 - 1], 4.0) for k in range(24)]
    events = told(rows)
    assert of(events, "merge", "track", "other") == [(2, 1)]
    assert sum(n for (n,) in of(events, "close", "n")) == len(rows)


def test_simultaneous_bursts_never_merge():
    rows = [x for k in range(8) for x in ((3 * k, 3 * k + 1, 100.0, 4.0), (3 * k + 0.5, 3 * k + 1.5, 102.9, 4.0))]
    assert of(told(rows, TrackRules(merge_gates=9.0)), "merge", "track") == []


def test_two_groups_split_and_stay_apart():
    rows = [(2 * k, 2 * k + 1, 100.0 + (1.8 if k % 3 == 0 else 0.0) + 0.01 * (k % 2), 4.0) for k in range(40)]
    events = told(rows)
    assert of(events, "split", "track", "other") == [(2, 1)] and of(events, "merge", "track") == []
    assert dict(of(events, "close", "track", "n")) == {1: 26, 2: 14} and len(of(events, "link", "track")) == 40


def test_one_group_does_not_split():
    rng = random.Random(4)
    assert of(told([(2 * k, 2 * k + 1, 100 + rng.gauss(0, 0.3), 4.0) for k in range(200)]), "split", "track") == []


@pytest.fixture
def hopper():
    """Five channels in a random order, each dwell 0.05 s, and two steady emitters that never abut."""
    rng, rows, last = random.Random(7), [], None
    for k in range(200):
        last = rng.choice([c for c in range(5) if c != last])
        rows.append((0.05 * k, 0.05 * (k + 1), 100.0 + 20 * last, 8.0))
    return rows + [(0.325 + k, 0.365 + k, 300.0, 8.0) for k in range(10)] + [(0.52 + k, 0.93 + k, 400.0, 8.0) for k in range(10)]


def test_hop_sets(spark, hopper):
    rows = [("rx", int(e * S), int(s * S), k, c, w) for k, (s, e, c, w) in enumerate(hopper)]
    df = spark.createDataFrame(rows, "receiver string, end_us long, start_us long, detection long, centre double, width double")
    found = tracks(df, ["receiver"]).cache()
    sets = [r.asDict() for r in hop_sets(found, ["receiver"]).collect()]
    closed = {r["track"]: r["n"] for r in found.where("event = 'close'").collect()}
    assert len(sets) == 5 and sum(closed[s["track"]] for s in sets) == 200
    assert {s["hop_set"] for s in sets} == {min(s["track"] for s in sets)} and all(s["n_hops"] >= 150 for s in sets)
    found.unpersist()


def test_survivors(spark):
    rows = [("a", 3, "merge", 2), ("a", 2, "merge", 1), ("b", 3, "merge", 1), ("b", 9, "open", None)]
    df = spark.createDataFrame(rows, "receiver string, track long, event string, other long")
    assert sorted(map(tuple, survivors(df, ["receiver"]).collect())) == [("a", 2, 1), ("a", 3, 1), ("b", 3, 1)]


def test_most_open_bounds_the_state():
    rules = TrackRules(most_open=3)
    events = told([(k, k + 0.5, 50.0 * k, 4.0) for k in range(8)], rules)
    assert [t for (t,) in of(events, "close", "track")] == list(range(1, 9))
    tracker, state = BurstTracker(rules), BurstTracker(rules).start()
    for k in range(50):
        tracker.step(state, (k * S + 1, k * S, k, 50.0 * k, 4.0))
        assert len(state["tracks"]) <= 3
    for k in range(100):
        tracker.step(state, ((100 + k) * S, (100 + k) * S - 9, k, 50.0, 4.0))
        assert all(len(t["bursts"]) <= rules.kept for t in state["tracks"])


def test_stream_equals_batch_however_files_fall(spark, tmp_path):
    """Three receivers, boxes out of order within the lateness, many small files."""
    rng = random.Random(11)
    rows = []
    for receiver in ("a", "b", None):
        t = 0.0
        for k in range(150):
            t += rng.expovariate(1 / 20)
            away = rng.random() < 0.05
            rows.append((receiver, int((t + rng.random() * 5) * S), int(t * S), k, None if away else rng.choice([50.0, 51.0, 90.0]), 4.0))
    shape = "receiver string, end_us long, start_us long, detection long, centre double, width double"
    rows.sort(key=lambda r: r[1] + rng.uniform(0, 500) * S)  # late by up to 500 s
    for k in range(0, len(rows), 90):
        part = spark.createDataFrame(rows[k : k + 90], shape).withColumn("ts", F.timestamp_micros("end_us"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    want = sorted(map(str, tracks(batch, ["receiver"]).collect()))
    tracker = BurstTracker()
    plain = []
    for receiver in ("a", "b", None):
        state = tracker.start()
        for row in sorted((r[1:] for r in rows if r[0] == receiver), key=lambda r: r[:3]):
            plain += [(receiver, *e) for e in tracker.step(state, row)]
        plain += [(receiver, *e) for e in tracker.end(state)]
    assert sorted(map(str, spark.createDataFrame(plain, f"receiver string, {EVENTS}").collect())) == want
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "tracks", ["receiver"], DETECTION, BurstTracker(), EVENTS, "ts", "600 seconds")
    assert sorted(map(str, got.collect())) == want


def test_queries_of_tracks_agree(spark):
    from spectraloom.plans import QUERIES

    sf = "/root/testdata/sf0.001"
    batch = sorted(map(str, QUERIES["burst_tracks"](spark, sf).collect()))
    assert batch == sorted(map(str, QUERIES["stream_tracks"](spark, sf).collect())) and any("'merge'" in r or "'close'" in r for r in batch)


def test_the_nearest_of_many_clusters_is_found_as_defined():
    from spectraloom.operators.assigning import ClusterFold

    rng = random.Random(12)
    fold, state = ClusterFold([4.0, 1.0, 0.6, 4.0]), []
    for i in range(1500):
        fields = [None if rng.random() < 0.1 else {"value": float(rng.choice([rng.randrange(60), rng.gauss(20, 9)])), "spread": rng.choice([None, 0.5, 2.0])} for _ in range(4)]
        asked = [None if f is None else (f["value"], f["spread"] or 0.0) for f in fields]
        want = min(((d, k) for k, c in enumerate(state) if (d := fold._distance(asked, c)) is not None and d <= 1), default=None)
        ((_, cluster, distance, founded, _),) = fold.step(state, (i, i, fields))
        assert (cluster, distance, founded) == ((len(state), None, True) if want is None else (want[1] + 1, want[0], False))
    assert len(state) > 200 and fold._means(state).shape[0] == len(state)


def test_folds_keep_their_tasks(spark):
    from spectraloom.operators.attention import published

    few = spark.range(2000).selectExpr("id % 400 as site", "id as t_us", "id as subject", "cast(1 as double) as score")
    out = published(few, ["site"], 10)
    out.count()
    assert out.rdd.getNumPartitions() >= 32  # few bytes, but each row is work for Python
