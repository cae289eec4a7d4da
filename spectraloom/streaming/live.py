"""Streaming forms of the log operators. Each gives, over a whole log, what its batch form gives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators.sequences import hysteresis_steps
from spectraloom.sources.shared import scratch
from spectraloom.sources.tables import micros, table
from spectraloom.streaming.carried import drained_carried


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 64) -> DataFrame:
    """The observation log as a stream of its files: event_id, channel, tier, level, ts, props."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        raw = stream.parquet(path)
    else:  # a stream reads folders
        raw = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.select("event_id", F.col("user_id").alias("channel"), F.col("event_type").alias("tier"), F.col("value").alias("level"), F.timestamp_micros(micros("ts")).alias("ts"), "props")


def tumbling_occupancy(events: DataFrame, length: str = "15 minutes", late: str = "40 days") -> DataFrame:
    """Visits and their share above 100 by channel and window. Rows later than ``late`` are dropped by Spark."""
    w = events.withWatermark("ts", late).groupBy("channel", F.window("ts", length).alias("w"))
    return w.agg(F.count("*").alias("n"), F.sum((F.col("level") >= 100).cast("int")).alias("n_occupied")).select("channel", F.unix_micros("w.start").alias("t_us"), "n", "n_occupied")


def sliding_level(events: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str = "40 days") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy("tier", F.window("ts", length, slide).alias("w"))
    return w.agg(F.count("*").alias("n"), F.max("level").alias("max_db")).select("tier", F.unix_micros("w.start").alias("t_us"), "n", "max_db")


SESSIONS = "first long, last long, n long, closed boolean"


class SessionFold:
    """Presence closed by an idle time (``SESSIONS``); a row exactly the idle time later opens a new one. Three numbers of state."""

    def __init__(self, idle_us: int):
        self.idle = idle_us

    def start(self) -> dict:
        return {"first": None, "last": None, "n": 0}

    def step(self, state: dict, row: tuple) -> list[tuple]:
        (t,) = row
        out = []
        if state["n"] and t - state["last"] >= self.idle:
            out = [(state["first"], state["last"], state["n"], True)]
            state["n"] = 0
        state["first"] = t if not state["n"] else state["first"]
        state["last"] = t
        state["n"] += 1
        return out

    def end(self, state: dict) -> list[tuple]:
        return [(state["first"], state["last"], state["n"], False)] if state["n"] else []


def drained_presence(events: DataFrame, idle_us: int = 21_600_000_000, late: str = "1 day") -> DataFrame:
    """channel and ``SESSIONS`` of a finite stream: each session once, when it is closed, and those still open at its end."""
    rows = events.withColumn("t_us", F.unix_micros("ts"))
    return drained_carried(rows, "presence", ["channel"], ["t_us"], SessionFold(idle_us), SESSIONS, "ts", late)


ALARM_COLUMNS = ["t_us", "event_id", "level"]
ALARM_STEPS = "event_id long, step string"


class AlarmFold:
    """The hysteresis of alarms over a channel's visits (``ALARM_COLUMNS``, the level in hundredths): ``ALARM_STEPS``, four numbers of state."""

    def __init__(self, on: float = 0.7, off: float = 0.4, raise_after: int = 2, clear_after: int = 3, reopen: int = 86_400_000_000):
        self.rules = (on, off, raise_after, clear_after, reopen)

    def start(self) -> list:
        return [False, 0, 0, -1]

    def step(self, state: list, row: tuple) -> list[tuple]:
        t, event, level = row
        score = float("nan") if level is None else level / 100  # a null is neither high nor low
        (step,), state[:] = hysteresis_steps([score], [t], tuple(state), *self.rules)
        return [(event, step)]

    def end(self, state: list) -> tuple:
        return ()


def drained_alarms(events: DataFrame, late: str = "1 day", fold: AlarmFold | None = None) -> DataFrame:
    """event_id, channel, step of all rows of a finite stream, folded in order of time.

    Rows are held until the watermark, ``late`` behind the newest time, has passed them; rows later than that are dropped. A
    channel's state is its alarm and the rows of the last ``late``, and a row is folded once.
    """
    rows = events.withColumn("t_us", F.unix_micros("ts"))
    return drained_carried(rows, "alarms", ["channel"], ALARM_COLUMNS, fold or AlarmFold(), ALARM_STEPS, "ts", late)


def sealed_tiles(events: DataFrame, hours: int = 1, late: str = "2 hours") -> DataFrame:
    """Tiles of tier by hours that are given once, when the watermark has passed their end; later rows are dropped by Spark."""
    w = events.withWatermark("ts", late).groupBy("tier", F.window("ts", f"{hours} hours").alias("w"))
    tile = w.agg(F.count("*").alias("n"), F.max("level").alias("max_db"), F.sum(F.pow(F.lit(10.0), F.col("level") / 100)).alias("power"))
    return tile.select("tier", F.unix_micros("w.start").alias("t_us"), "n", "max_db", "power")


def around_triggers(samples: DataFrame, triggers: DataFrame, before: str, after: str, late: str = "1 hour") -> DataFrame:
    """Samples of a trigger's channel from ``before`` its time to ``after`` it, the end left out: a join of two streams.

    ``samples``: channel, ts, level; ``triggers``: trigger_id, channel, ts. State is held as long as the times allow a match.
    """
    s = samples.select("channel", "ts", "level").withWatermark("ts", late)
    t = triggers.select("trigger_id", F.col("channel").alias("t_channel"), F.col("ts").alias("t_ts")).withWatermark("t_ts", late)
    inside = F.expr(f"channel = t_channel AND ts >= t_ts - INTERVAL {before} AND ts < t_ts + INTERVAL {after}")
    return s.join(t, inside).select("trigger_id", "channel", F.unix_micros("ts").alias("t_us"), "level")


def drained(stream: DataFrame, name: str, mode: str = "append", keys: tuple[str, ...] = ()) -> DataFrame:
    """All that a finite stream gives: run until its input is used up, written to the shared folder and read back.

    In update mode a batch writes only the rows it changed, and of each ``keys`` the row of the newest batch holds; a batch
    that is run again after a failure overwrites its own folder. In complete mode the last batch has all rows.
    """
    spark = stream.sparkSession
    at = scratch(spark, f"stream-{name}")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/out/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    if mode == "update":
        rest = [c for c in stream.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == last).drop("batch")
