from pyspark.sql import functions as F

from spectraloom.operators import sequences as Q
from spectraloom.plans import QUERIES
from spectraloom.streaming import live


def test_alarms_do_not_depend_on_the_order_of_files(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    slices = events.withColumn("part", F.pmod(F.dayofmonth("ts") * 7, F.lit(4))).withColumn("user_id", F.col("user_id") % 3)
    for i in (2, 0, 3, 1):
        slices.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    log = spark.read.parquet(str(tmp_path / "events.parquet")).select("event_id", F.col("user_id").alias("channel"), (F.col("value") / 100).alias("x"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    want = sorted((r.event_id, r.channel, r.step) for r in Q.hysteresis(log, "channel", "t", "event_id", "x", reopen=86_400_000_000).collect())
    assert {s for _, _, s in want} >= {"raise", "clear", "quiet", "hold"}
    got = live.drained_alarms(live.event_stream(spark, str(tmp_path), 1), "40 days")
    assert sorted((r.event_id, r.channel, r.step) for r in got.collect()) == want
    assert sorted((r.event_id, r.channel, r.step) for r in QUERIES["stream_alarms"](spark, str(tmp_path)).collect()) == want


def test_alarms_drop_what_is_later_than_allowed(spark, tmp_path):
    """Files out of order within the lateness change nothing; a row beyond it is left out, as if it had never been."""
    S = 1_000_000
    shape = "event_id long, user_id long, event_type string, value double, props string, t long"
    files = [[(0, 0.0, 100), (1, 90.0, 400)], [(2, 90.0, 300), (3, 90.0, 4000)], [(4, 10.0, 3900)], [(5, 90.0, 4100), (6, 99.0, 350)]]
    for rows in files:
        df = spark.createDataFrame([(i, 7, "x", x, "{}", t * S) for i, x, t in rows], shape)
        df.select("event_id", F.timestamp_micros("t").alias("ts"), "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: r.step for r in live.drained_alarms(live.event_stream(spark, str(tmp_path), 1), "1000 seconds").collect()}
    kept = sorted((t, x, i) for rows in files for i, x, t in rows if i != 6)
    want, _ = Q.hysteresis_steps([x / 100 for _, x, _ in kept], [t * S for t, *_ in kept], reopen=86_400_000_000)
    assert got == {i: s for (_, _, i), s in zip(kept, want, strict=True)}
