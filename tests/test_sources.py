import json
import math
import struct

from pyspark.sql import functions as F

from spectraloom.sources import signal_files as S


def test_recordings(spark, tmp_path):
    meta = {
        "global": {"core:datatype": "ci8", "core:version": "1.0.0", "core:sample_rate": 1000.0, "extra": 1},
        "captures": [{"core:sample_start": 0, "core:frequency": 1e8, "core:datetime": "2024-01-01T00:00:00Z"}],
        "annotations": [{"core:sample_start": 500, "core:sample_count": 250, "core:freq_lower_edge": 1.0, "core:freq_upper_edge": 2.0, "core:label": "x"}],
    }
    (tmp_path / "a.sigmf-meta").write_text(json.dumps(meta, indent=1))
    rec = S.read_recordings(spark, str(tmp_path / "*.sigmf-meta"))
    assert rec.first().datatype == "ci8"
    a = S.recording_annotations(rec).first()
    assert (a.t_start_s, a.t_end_s, a.label) == (0.5, 0.75, "x")
    (tmp_path / "s.data").write_bytes(struct.pack("4b", -128, 0, 64, 127))
    assert S.read_samples(spark, str(tmp_path / "s.data"), "ci8").first().samples == [-1.0, 0.0, 0.5, 127 / 128]


def test_sweeps_round_trip(spark, tmp_path):
    cells = spark.sql("SELECT timestamp'2024-01-02 03:04:05' AS t, id AS bin, CASE WHEN id = 3 THEN NULL ELSE -id * 1.5D END AS db FROM range(8)")
    S.sweep_lines(cells, 1000.0, 4).write.text(str(tmp_path / "sweep"))
    (tmp_path / "sweep" / "bad.txt").write_text("not a sweep line\n2024-01-02, 03:04:05, x, 1, 2, 3, 4\n")
    got = {r.f_hz: r.db for r in S.read_sweeps(spark, str(tmp_path / "sweep")).collect()}
    assert got == {500.0: 0.0, 1500.0: -1.5, 2500.0: -3.0, 3500.0: None, 4500.0: -6.0, 5500.0: -7.5, 6500.0: -9.0, 7500.0: -10.5}


def test_observation_log_skips_damage(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b c")], "n int, s string")
    good = [r.value for r in S.observation_log_lines(rows).collect()]
    (tmp_path / "log").write_text("\n".join([*good, good[0].replace('"a"', '"x"'), "garbage", ""]))
    assert sorted(map(tuple, S.read_observation_log(spark, str(tmp_path / "log"), "n int, s string").collect())) == [(1, "a"), (2, "b c")]


def test_day_store(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.createDataFrame([(i, i * day // 2, i * day // 2 + 1000) for i in range(10)], "i int, a long, b long")
    S.append_by_day(rows, str(tmp_path / "store"), "a", "b")
    S.append_by_day(rows.where("i = 3").withColumn("i", F.lit(30)), str(tmp_path / "store"), "a", "b")
    found, cut = S.scan_days(spark, str(tmp_path / "store"), "a", "b", day, 2 * day, 2)
    assert found.count() == 3 and found.agg(cut).first()[0]
    found, cut = S.scan_days(spark, str(tmp_path / "store"), "a", "b", day, 2 * day, 5)
    assert sorted(r.i for r in found.collect()) == [2, 3, 30] and not found.agg(cut).first()[0]
    files = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (3, 5)], "day int, bytes int")
    assert [r.day for r in S.days_to_drop(files, 25).collect()] == [1]


def test_lines(spark):
    text = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    body = "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"
    check = sum(int(c) if c.isdigit() else c == "-" for c in body[:68]) % 10
    good = body[:68] + str(check)
    r = S.orbit_elements(text(good, body[:68] + str((check + 1) % 10), "1 x")).collect()
    assert len(r) == 1 and r[0].catalog == 25544 and math.isclose(r[0].eccentricity, 0.0006703) and math.isclose(r[0].inclination, 51.6416)
    nmea = "GPGGA,123519,4807.038,N,01131.000,W,1,08,0.9,545.4,M,46.9,M,,"
    x = 0
    for c in nmea:
        x ^= ord(c)
    r = S.positions(text(f"${nmea}*{x:02X}", f"${nmea}*{x ^ 1:02X}", "$GPGGA")).collect()
    assert len(r) == 1 and math.isclose(r[0].lat, 48 + 7.038 / 60) and math.isclose(r[0].lon, -(11 + 31 / 60)) and r[0].time_s == 45319
    assert S.device_specs(text("# c", "", "n=a,m=OOK,s=100")).first().spec == {"n": "a", "m": "OOK", "s": "100"}
    m = S.messages(text('{"type":"a","v":1}', '{"type":"z","v":2}', "nope"), "type string, v int", ["a"]).collect()
    assert [tuple(r) for r in m] == [("a", 1)]
    snap = spark.createDataFrame([("k", 1, "old"), ("k", 5, "new"), ("q", 2, "x")], "k string, t int, v string")
    assert sorted(map(tuple, S.latest_snapshot(snap, ["k"], "t", 6, 2).collect())) == [("k", 5, "new", False), ("q", 2, "x", True)]


def test_stream_of_several_files(spark, tmp_path):
    from spectraloom.streaming import live

    d = tmp_path / "events.parquet"
    whole = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts", "event_id")
    n = whole.count()
    for i, part in enumerate((whole.limit(n // 2), whole.offset(n // 2))):
        part.coalesce(1).write.mode("append").parquet(str(d))
    stream = live.event_stream(spark, str(tmp_path), files_per_trigger=1)
    got = {r.event_id: r.step for r in live.drained_alarms(stream).collect()}
    assert len(got) == n
    sessions = live.drained_presence(live.event_stream(spark, str(tmp_path), 1)).collect()
    assert sum(r.n for r in sessions) == n and sum(not r.closed for r in sessions) == whole.select("user_id").distinct().count()


def test_tiles_seal_and_triggers_reach_back(spark, tmp_path):
    from spectraloom.streaming import live

    rows = [(i, f"2024-01-0{1 + i // 24} {i % 24:02d}:30:00", i % 2, "view", float(i), "{}") for i in range(72)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for part in (df.where("event_id < 36"), df.where("event_id >= 36")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    tiles = live.drained(live.sealed_tiles(live.event_stream(spark, str(tmp_path), 1), 6, "1 hour"), "tiles")
    sealed = {r.t_us: r.n for r in tiles.collect()}
    assert set(sealed.values()) == {6} and 10 <= len(sealed) <= 12
    samples, triggers = live.event_stream(spark, str(tmp_path), 1), live.event_stream(spark, str(tmp_path), 1)
    triggers = triggers.where("event_id % 10 = 0").select(F.col("event_id").alias("trigger_id"), "channel", "ts")
    cut = live.drained(live.around_triggers(samples, triggers, "4 hours", "2 hours", "100 hours"), "cut")
    got = sorted((r.trigger_id, int(r.level)) for r in cut.collect())
    assert got == sorted((t, s) for t in range(0, 72, 10) for s in range(72) if s % 2 == t % 2 and t - 4 <= s < t + 2)


def test_scans_find_rows_of_many_days(spark, tmp_path):
    day = 86_400_000_000
    rows = spark.createDataFrame([(1, 0, 4 * day), (2, 2 * day, 2 * day + 5), (3, 3 * day + 1, 3 * day + 2), (4, 9 * day, 10 * day)], "i int, a long, b long")
    S.append_by_day(rows, str(tmp_path / "store"), "a", "b")
    found, _ = S.scan_days(spark, str(tmp_path / "store"), "a", "b", 3 * day, 5 * day, 10)
    assert sorted(r.i for r in found.collect()) == [1, 3]
    files = spark.createDataFrame([(1, 5), (2, 5), (3, 5)], "day long, bytes long")
    assert sorted(r.day for r in S.days_to_drop(files, 100, oldest=3).collect()) == [1, 2]
