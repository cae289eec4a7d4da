"""Operators that carry state along a receiver's rows, as queries over the observation log: tracks, frames, symbols, spectra, sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import assigning, audio, demod, framing, moving, recordings, tracking
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, visits
from spectraloom.streaming.carried import drained_carried
from spectraloom.streaming.live import event_stream

DAY = 86_400_000_000
#: Visits last minutes and channels lie a unit apart: the tracker's times in days, hops within an hour.
TRACKS = tracking.TrackRules(idle_us=5 * DAY, longest_idle_us=15 * DAY, hop_us=DAY // 24, hop_ratio=3.0)


@query()
def burst_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tracker tells of each channel's visits as bursts."""
    return tracking.tracks(tracking.receiver_detections(visits(spark, sf_dir)), ["channel"], TRACKS)


@query()
def stream_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the log as a stream whose rows may come up to a day late."""
    e = event_stream(spark, sf_dir).withColumn("cell", F.get_json_object("props", "$.k").cast("long")).withColumn("start_us", F.unix_micros("ts"))
    e = e.withColumn("end_us", F.col("start_us") + (F.floor("level") + 60) * 1_000_000)
    rows = tracking.receiver_detections(e).withColumn("ended", F.timestamp_micros("end_us"))
    return drained_carried(rows, "tracks", ["channel"], tracking.DETECTION, tracking.BurstTracker(TRACKS), tracking.EVENTS, "ended", "1 day")


@query()
def track_hop_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks of a channel that hop among each other, three at least with three hops."""
    return tracking.hop_sets(burst_tracks(spark, sf_dir), ["channel"], links=1, channels=3, hops=3)


FRAME_RULES = framing.LengthRules(64, 3, field=(4, 5), cases=((0, 3, 24),), scale=2, add=16, words=("0111111",), trailer=4)
_BITS_SQL = f"""{VISITS_SQL}, b AS (SELECT channel, event_id, start_us, tier, lpad(bin((level * 100)::BIGINT % 65536), 16, '0') AS bits,
  row_number() OVER o AS i, sum((tier = 'error')::INT) OVER o AS seg FROM v WINDOW o AS (PARTITION BY channel ORDER BY start_us, event_id))"""


@query(f"""WITH RECURSIVE {_BITS_SQL},
s AS MATERIALIZED (SELECT channel, seg, (min(i) - 1) * 16 AS base, string_agg(bits, '' ORDER BY i) AS s FROM b GROUP BY channel, seg),
f(channel, seg, base, s, pos, n, how) AS (
  SELECT channel, seg, base, s, 3::BIGINT, 0::BIGINT, '' FROM s
  UNION ALL SELECT channel, seg, base, s, pos, least(told, closed, 64), CASE WHEN told <= closed AND told <= 64 THEN 'length' WHEN closed <= 64 THEN 'terminator' ELSE 'most' END FROM (
    SELECT channel, seg, base, s, pos + n AS pos,
      CASE WHEN length(s) - pos - n >= 9 THEN greatest(9, CASE WHEN v <= 3 THEN 24 ELSE v * 2 + 16 END) ELSE 1000 END AS told, CASE WHEN p > 0 THEN p + 10 ELSE 1000 END AS closed
    FROM (SELECT *, strpos(substr(s, pos + n + 1, 64), '0111111') AS p, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr(s, pos + n + 5, 5), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE x::BIGINT END)), lambda a, x: 2 * a + x) AS v FROM f))
  WHERE least(told, closed, 64) <= length(s) - pos)
SELECT channel, (row_number() OVER (PARTITION BY channel ORDER BY seg, pos) - 1)::BIGINT AS frame, (base + pos)::BIGINT AS first_bit, n::INT AS n_bits, how AS ended, substr(s, pos + 1, n) AS bits FROM f WHERE n > 0""")
def deframed_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a length field, a terminator or 64 bits at most from each channel's stream of 16 bits a visit; an ``error`` breaks it."""
    bits = F.lpad(F.conv(((F.col("level") * 100).cast("decimal(20,0)").cast("long") % 65536).cast("string"), 10, 2), 16, "0")
    blocks = visits(spark, sf_dir).select("channel", "start_us", "event_id", bits.alias("bits"), (F.col("tier") == "error").alias("reset"))
    return framing.deframed(blocks, ["channel"], ["start_us", "event_id"], "bits", "reset", FRAME_RULES)


@query(f"""WITH RECURSIVE {VISITS_SQL}, h AS (SELECT tier, end_us, start_us, channel, CASE WHEN level < 30 THEN 0 WHEN level < 60 THEN 1 ELSE 2 END AS rank, cell::VARCHAR AS payload FROM v),
o AS (SELECT *, row_number() OVER (PARTITION BY tier, payload ORDER BY end_us, start_us, channel, rank) AS i FROM h),
t(tier, payload, i, first, heard) AS (SELECT tier, payload, i, end_us, [channel] FROM o WHERE i = 1
  UNION ALL SELECT o.tier, o.payload, o.i, CASE WHEN new THEN o.end_us ELSE first END, CASE WHEN new THEN [o.channel] ELSE list_append(heard, o.channel) END
  FROM (SELECT o.*, first, heard, o.end_us - first > {DAY} OR list_contains(heard, o.channel) AS new FROM t JOIN o ON o.tier = t.tier AND o.payload IS NOT DISTINCT FROM t.payload AND o.i = t.i + 1) o),
g AS (SELECT o.*, sum((len(heard) = 1)::INT) OVER (PARTITION BY o.tier, o.payload ORDER BY o.i) AS g FROM o JOIN t ON o.tier = t.tier AND o.payload IS NOT DISTINCT FROM t.payload AND o.i = t.i),
b AS (SELECT tier, payload, g, arg_min({{'channel': channel, 'start_us': start_us, 'end_us': end_us, 'rank': rank}}, (rank, i)) AS b, count(*) AS copies, arg_min((end_us, start_us, channel, rank, payload), i) AS first FROM g GROUP BY ALL)
SELECT tier, row_number() OVER (PARTITION BY tier ORDER BY first) AS seq, b.channel, b.start_us, b.end_us, payload, b.rank::INT AS rank, copies::INT AS copies FROM b""")
def followed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits of all channels of a tier as one stream; a cell heard on another channel within a day is a copy."""
    rank = F.when(F.col("level") < 30, 0).when(F.col("level") < 60, 1).otherwise(2)
    frames = visits(spark, sf_dir).select("tier", "end_us", "start_us", "channel", rank.alias("rank"), F.col("cell").cast("string").alias("payload"))
    return framing.follow_hops(frames, ["tier"], DAY)


_BLOCK, _N, _HOP = 24, 16, 8


@query(f"""WITH {VISITS_SQL}, r AS (SELECT channel, tier, level, row_number() OVER (PARTITION BY channel ORDER BY start_us, event_id) - 1 AS i FROM v),
b AS (SELECT *, (i % {_BLOCK} = 0 AND tier = 'error' AND i > 0)::INT AS breaks FROM r), g AS (SELECT *, sum(breaks) OVER (PARTITION BY channel ORDER BY i) AS segment FROM b),
x AS (SELECT channel, segment, level, i - min(i) OVER w AS j, min(i) OVER w AS origin, count(*) OVER w AS n FROM g WINDOW w AS (PARTITION BY channel, segment)),
f AS (SELECT channel, segment, origin, frame, j - frame * {_HOP} AS k, level * (0.5 - 0.5 * cos(2 * pi() * (j - frame * {_HOP}) / {_N})) AS y FROM x, LATERAL (SELECT unnest(range(greatest(0, (j - {_N}) // {_HOP}), j // {_HOP} + 1)) AS frame)
  WHERE j >= frame * {_HOP} AND j < frame * {_HOP} + {_N} AND frame * {_HOP} + {_N} <= n)
SELECT channel, segment::BIGINT AS segment, frame, (origin + frame * {_HOP})::BIGINT AS first_sample, b::INT AS bin,
  round((pow(sum(y * cos(2 * pi() * b * k / {_N})), 2) + pow(sum(y * sin(2 * pi() * b * k / {_N})), 2)) / {3 * _N / 8}, 3) AS power FROM f CROSS JOIN range({_N // 2 + 1}) t(b) GROUP BY channel, segment, frame, origin, b""")
def recording_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spectrum of every 16 levels of a channel, 8 apart, over blocks of 24 visits; a block that begins with an ``error`` breaks the recording."""
    i = F.row_number().over(Window.partitionBy("channel").orderBy("start_us", "event_id")) - 1
    rows = visits(spark, sf_dir).select("channel", "level", "tier", i.cast("long").alias("i")).withColumn("block", F.floor(F.col("i") / _BLOCK))
    each = F.array_sort(F.collect_list(F.struct("i", "level", "tier")))
    blocks = rows.groupBy("channel", "block").agg(each.alias("x")).select("channel", F.col("x")[0]["i"].alias("at"), F.transform("x", lambda v: v["level"]).alias("samples"), (F.col("x")[0]["tier"] == "error").alias("reset"))
    spectra = recordings.stft(blocks, ["channel"], "at", "samples", _N, _HOP, "reset", group=16)
    return spectra.select("channel", "segment", "frame", F.col("at").alias("first_sample"), F.posexplode("power").alias("bin", "power")).withColumn("power", F.round("power", 3))


#: Samples a symbol as planted, 200 parts in a million above what the receiver expects.
_PERIOD, _PLANTED = 5.0, 5.001


@query(f"WITH {VISITS_SQL} SELECT channel, row_number() OVER (PARTITION BY channel ORDER BY start_us, event_id) - 1 AS symbol, (level >= 35)::INT AS bit FROM v")
def recovered_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's visits above level 35 or below, sent as a two-level waveform whose clock is off, and recovered from its blocks of samples."""
    by = Window.partitionBy("channel").orderBy("start_us", "event_id")
    sent = visits(spark, sf_dir).select("channel", (F.row_number().over(by) - 1).alias("k"), F.lead("event_id").over(by).isNull().alias("last"), F.when(F.col("level") >= 35, 1.0).otherwise(-1.0).alias("x"))
    begin = lambda k: F.ceil(k * F.lit(_PLANTED))
    held = F.sequence(begin(F.col("k")), begin(F.col("k") + 1) - 1 + F.when(F.col("last"), 2).otherwise(0))  # the last level stays a little longer
    noise = (F.pmod(F.xxhash64("channel", "i"), F.lit(1000)) - 500) / 2000.0
    samples = sent.select("channel", F.explode(held).alias("i"), "x").select("channel", "i", (F.col("x") + noise).alias("x"), F.floor(F.col("i") / 64).alias("block"))
    blocks = samples.groupBy("channel", "block").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("s")).select("channel", F.col("s")[0]["i"].alias("at"), F.transform("s", lambda v: v["x"]).alias("samples"), F.lit(False).alias("reset"))
    found = recordings.symbols(blocks, ["channel"], "at", "samples", "reset", recordings.ClockRules(_PERIOD))
    return found.select("channel", "symbol", (F.col("value") > 0).cast("int").alias("bit"))


@query()
def device_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a channel's device is, from fixes made of its visits: a cell is a place 100 m from the next one, an ``error`` has no fix."""
    fix = F.col("tier") != "error"
    fixes = visits(spark, sf_dir).select("channel", F.col("start_us").alias("t_us"), F.when(fix, 50 + F.floor(F.col("cell") / 25) * 0.0009).alias("lat"), F.when(fix, F.lit(8.0)).alias("lon"), F.when(fix & (F.col("level") > 200), F.lit(9.0)).when(fix, F.lit(0.0)).alias("speed"))
    return moving.assigned_sites(fixes, ["channel"], moving.SiteRules(mobile_window_s=2 * 86_400.0, hold_s=86_400.0, radius_m=250.0))


_PULSES = demod.PulseRules(bits=16)


@query(f"WITH {VISITS_SQL} SELECT channel, (row_number() OVER (PARTITION BY channel ORDER BY start_us, event_id) - 1) * 110 + 7 AS at_sample, lpad(bin(cell * 499), 16, '0') AS bits FROM v")
def pulse_trains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each visit sends its cell as a frame of pulse positions in noise; what is decoded from a channel's magnitudes, block by block."""
    k = F.row_number().over(Window.partitionBy("channel").orderBy("start_us", "event_id")) - 1
    bits = F.lpad(F.conv((F.col("cell") * 499).cast("string"), 10, 2), 16, "0")
    preamble = F.array(*[F.lit(1.0 if i in _PULSES.pulses else 0.0) for i in range(_PULSES.preamble)])
    halves = F.flatten(F.transform(F.split(bits, ""), lambda b: F.when(b == "1", F.array(F.lit(1.0), F.lit(0.0))).when(b == "0", F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array().cast("array<double>"))))
    sent = F.flatten(F.transform(F.concat(preamble, halves), lambda v: F.array_repeat(v, _PULSES.half)))
    silence = lambda n: F.array_repeat(F.lit(0.0), n)
    noise = lambda i: F.pmod(F.xxhash64("event_id", i), F.lit(1000)) / 5000.0
    samples = F.transform(F.concat(silence(7), sent, silence(7)), lambda v, i: v + noise(i))
    blocks = visits(spark, sf_dir).select("channel", (k * 110).cast("long").alias("at"), samples.alias("samples"), F.lit(False).alias("reset"))
    tail = blocks.groupBy("channel").agg((F.max("at") + 110).alias("at")).select("channel", "at", silence(_PULSES.half).alias("samples"), F.lit(False).alias("reset"))
    found = demod.pulse_frames(blocks.unionByName(tail), ["channel"], "at", "samples", "reset", _PULSES)
    return found.select("channel", F.col("at").alias("at_sample"), "bits")


@query()
def online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tier's visits as signatures of level, cell, hour and length, assigned to clusters as they come."""
    field = lambda c, spread: F.struct(c.cast("double").alias("value"), F.lit(spread).alias("spread"))
    hour = F.floor(F.col("start_us") / 3_600_000_000) % 24
    known = F.when(F.col("cell") % 7 != 0, F.col("cell"))  # a field may be unknown
    fields = F.array(field(F.col("level"), 5.0), field(known, 1.0), field(hour, 0.5), field((F.col("end_us") - F.col("start_us")) / 1e6, 5.0))
    rows = visits(spark, sf_dir).select("tier", F.col("start_us").alias("t_us"), F.col("event_id").alias("signature"), fields.alias("fields"))
    return assigning.assigned_clusters(rows, ["tier"], [40.0, 10.0, 6.0, 40.0])


@query(f"""WITH RECURSIVE {VISITS_SQL}, o AS (SELECT channel, level, row_number() OVER (PARTITION BY channel ORDER BY start_us, event_id) - 1 AS i FROM v),
y(channel, i, y) AS (SELECT channel, i, level FROM o WHERE i = 0 UNION ALL SELECT o.channel, o.i, y + (1 - exp(-0.25)) * (o.level - y) FROM y JOIN o ON o.channel = y.channel AND o.i = y.i + 1)
SELECT channel, i, round(y, 6) AS y FROM y""")
def deemphasised_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's levels through a low pass of four samples, block by block of 32."""
    i = (F.row_number().over(Window.partitionBy("channel").orderBy("start_us", "event_id")) - 1).cast("long")
    rows = visits(spark, sf_dir).select("channel", i.alias("i"), "level")
    blocks = rows.groupBy("channel", F.floor(F.col("i") / 32).alias("b")).agg(F.array_sort(F.collect_list(F.struct("i", "level"))).alias("x"))
    blocks = blocks.select("channel", F.col("x")[0]["i"].alias("at"), F.transform("x", lambda v: v["level"]).alias("samples"), F.lit(False).alias("reset"))
    out = audio.staged(blocks, ["channel"], "at", "samples", "reset", audio.Deemphasis(1.0, 4.0))
    return out.select("channel", F.col("at"), F.posexplode("samples").alias("k", "y")).select("channel", (F.col("at") + F.col("k")).alias("i"), F.round("y", 6).alias("y"))
