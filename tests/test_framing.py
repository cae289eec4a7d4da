"""Frames by length rules, merged channels and sites of devices, against plain recomputations, batches and streams."""

import random

import pytest
from pyspark.sql import functions as F

from spectraloom.operators.framing import FRAMES, HOP_COLUMNS, HOPS, Deframe, FollowHops, LengthRules, deframed, follow_hops
from spectraloom.operators.moving import FIX, SITES, SiteFold, SiteRules, assigned_sites
from spectraloom.streaming.carried import drained_carried

S = 1_000_000
RULES = [
    LengthRules(24),
    LengthRules(40, offset=5),
    LengthRules(64, 3, field=(4, 5), cases=((0, 3, 24), (9, 9, 12)), scale=2, add=16),
    LengthRules(64, field=(0, 4), cases=((1, 5, 20),), default=33),
    LengthRules(200, words=("01111110",), trailer=4),
    LengthRules(90, 1, field=(6, 6), scale=1, add=12, words=("111000", "0101010"), step=3, trailer=2),
]


def bit_by_bit(segments, rules):
    """Frames of whole segments, tested after every single bit."""
    out, base = [], 0
    for bits in segments:
        at = rules.offset
        body = ""
        target = done = None
        for k in range(at, len(bits)):
            body += bits[k]
            n = len(body)
            if rules.field and n == sum(rules.field):
                value = int(body[rules.field[0] :], 2)
                case = [b for low, high, b in rules.cases if low <= value <= high]
                target = case[0] if case else value * rules.scale + rules.add if rules.scale else rules.default
                target = None if target is None else max(n, target)
            if done is None and n % rules.step == 0 and any(body.endswith(w) for w in rules.words):
                done = n + rules.trailer
            how = "length" if n == target else "terminator" if n == done else "most" if n == rules.most else None
            if how:
                out.append((len(out), base + k + 1 - n, n, how, body))
                body, target, done = "", None, None
        base += len(bits)
    return out


@pytest.mark.parametrize("rules", RULES)
def test_frames_do_not_depend_on_blocks(rules):
    rng = random.Random(3)
    segments = ["".join(rng.choice("01") for _ in range(rng.randrange(2000))) for _ in range(4)] + ["", "0" * 500, "01111110" * 60]
    want = bit_by_bit(segments, rules)
    assert len(want) > 20
    for size in (1, 7, 64, 5000):
        fold = Deframe(rules)
        state, got = fold.start(), []
        for k, bits in enumerate(segments):
            blocks = [bits[i : i + size] for i in range(0, len(bits), size)] or [""]
            for i, block in enumerate(blocks):
                got += fold.step(state, (k, i, block, i == 0))
                assert len(state["rest"]) < rules.most
        assert got == want


def test_rules_that_cannot_be():
    for bad in (dict(most=0), dict(most=8, field=(4, 8)), dict(most=8, step=0)):
        with pytest.raises(ValueError):
            LengthRules(**bad)


def test_deframe_batch_and_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(key, (k + 1) * S, k, None if k == 17 else "".join(rng.choice("01") for _ in range(rng.randrange(60))), k % 20 == 9) for key in ("a", None) for k in range(60)]
    shape = "receiver string, t_us long, block long, bits string, reset boolean"
    df = spark.createDataFrame(rows, shape)
    want = []
    for key in ("a", None):
        segments = [""]
        for r in (r for r in rows if r[0] == key):
            if r[4] or r[3] is None:
                segments.append("")
            segments[-1] += r[3] or ""
        want += [(key, *f) for f in bit_by_bit(segments, RULES[2])]
    assert sorted(map(str, map(tuple, deframed(df, ["receiver"], ["t_us", "block"], "bits", "reset", RULES[2]).collect()))) == sorted(map(str, want))
    rng.shuffle(rows)
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], shape).withColumn("ts", F.timestamp_micros("t_us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "frames", ["receiver"], ["t_us", "block", "bits", "reset"], Deframe(RULES[2]), FRAMES, "ts", "70 seconds")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def plain_hops(rows, within):
    """Transmissions of a sorted list of frames."""
    sent = []
    for end, start, channel, rank, payload in sorted(rows):
        last = [s for s in sent if s["payload"] == payload][-1:]
        if last and end - last[0]["end"] <= within and channel not in last[0]["heard"]:
            last[0]["heard"].append(channel)
            if rank < last[0]["best"][3]:
                last[0]["best"] = (channel, start, end, rank)
        else:
            sent.append({"payload": payload, "end": end, "heard": [channel], "best": (channel, start, end, rank)})
    return [(k + 1, c, a, b, s["payload"], r, len(s["heard"])) for k, s in enumerate(sent) for c, a, b, r in [s["best"]]]


def test_follow_hops(spark, tmp_path):
    rng = random.Random(6)
    rows = []
    for _ in range(200):
        t, payload = rng.randrange(300 * S), rng.choice(["x", "y", "z", None])
        rows += [(e := t + rng.randrange(S), e - rng.randrange(9 * S), rng.randrange(5), rng.randrange(3), payload) for _ in range(rng.randrange(1, 5))]
    rows = sorted(set(rows), key=str)
    key = lambda p: "" if p is None else p
    want = plain_hops([(*r[:4], key(r[4])) for r in rows], S // 2)
    assert any(w[6] > 1 for w in want) and len(want) < len(rows)
    df = spark.createDataFrame([("h", *r) for r in rows], "hopper string, end_us long, start_us long, channel long, rank int, payload string").fillna("")
    assert sorted(map(tuple, (r[1:] for r in follow_hops(df, ["hopper"], S // 2).collect()))) == want
    parts = df.withColumn("ts", F.timestamp_micros("end_us"))
    for k in (2, 0, 3, 1):
        parts.where(F.pmod(F.xxhash64("end_us", "channel"), F.lit(4)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "hops", ["hopper"], HOP_COLUMNS, FollowHops(S // 2), HOPS, "ts", "400 seconds")
    assert sorted(map(tuple, (r[1:] for r in got.collect()))) == want


def way(rows, rules=None):
    fold = SiteFold(rules or SiteRules())
    state = fold.start()
    return [r[1:] for t, lat, lon, speed in rows for r in fold.step(state, (int(t * S), lat, lon, speed))]


def test_sites_of_a_device():
    still = [(10 * k, 50.0, 8.0, None) for k in range(8)]
    assert way(still)[:6] == [("unassigned", None, False)] * 6 and way(still)[6:] == [("site", 1, True), ("site", 1, False)]
    drive = still + [(80 + 10 * k, 50.0 + 0.002 * k, 8.0, None) for k in range(1, 20)]
    there = [(280 + 10 * k, 50.038, 8.0, 0.0) for k in range(1, 45)]
    back = [(3000 + 10 * k, 50.0001, 8.0, 0.0) for k in range(10)]
    out = way(drive + there + back)
    assert out[len(drive) - 1] == ("mobile", None, False) and ("site", 2, True) in out and out[-1] == ("site", 1, False)
    assert sum(f for *_, f in out) == 2


def test_sites_are_held_without_fixes():
    rows = [(10 * k, 50.0, 8.0, None) for k in range(8)] + [(70 + t, None, None, None) for t in (60, 3599, 3600, 3601)]
    assert [p for p, *_ in way(rows)][-4:] == ["site", "site", "site", "unassigned"]
    assert way([(0, 50.0, 8.0, 9.0)]) == [("mobile", None, False)] and way([(0, None, None, None)]) == [("unassigned", None, False)]


def test_sites_do_not_depend_on_files(spark, tmp_path):
    rng = random.Random(9)
    rows = []
    for device in range(3):
        lat, t = 50.0, 0.0
        for _ in range(120):
            t += rng.choice([5, 20, 400])
            lat += rng.choice([0, 0, 0, 0.00001, 0.003])
            rows.append((device, int(t * S), *((lat, 8.0, rng.choice([None, 0.0])) if rng.random() < 0.9 else (None, None, None))))
    shape = "device long, t_us long, lat double, lon double, speed double"
    df = spark.createDataFrame(rows, shape)
    want = [(d, *r) for d in range(3) for fold in [SiteFold()] for state in [fold.start()] for row in rows if row[0] == d for r in fold.step(state, row[1:])]
    assert sorted(map(str, map(tuple, assigned_sites(df.orderBy(F.rand(1)), ["device"]).collect()))) == sorted(map(str, want))
    parts = df.withColumn("ts", F.timestamp_micros("t_us"))
    for k in (1, 2, 0):
        parts.where(F.col("t_us") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(parts.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drained_carried(stream, "sites", ["device"], FIX, SiteFold(), SITES, "ts", "1 day")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
