"""Blind estimates as queries: Spark makes signals of the log's rows by a known rule, and what is estimated has to be that rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import blind, inference
from spectraloom.plans.registry import query
from spectraloom.sources.shared import spread
from spectraloom.sources.tables import VISITS_SQL, visits

_SEQ = f"{VISITS_SQL}, o AS (SELECT *, row_number() OVER w - 1 AS k, lag(level >= 35) OVER w AS before FROM v WINDOW w AS (PARTITION BY channel ORDER BY start_us, event_id))"


def _series(spark: SparkSession, sf_dir: str, value) -> DataFrame:
    """channel, x: an array with ``value`` of each visit, in order. A channel's visits are one signal."""
    rows = visits(spark, sf_dir).select("channel", (F.row_number().over(Window.partitionBy("channel").orderBy("start_us", "event_id")) - 1).alias("k"), value.alias("x"))
    return rows.groupBy("channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("x"))


@query(f"WITH {_SEQ} SELECT channel, (8 + channel % 5)::INT AS unit FROM o GROUP BY channel HAVING sum((before <> (level >= 35))::INT) >= 20")
def symbol_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples a symbol of each channel with twenty level changes: its visits above level 35 or below, held for 8 to 12 samples each."""
    s = _series(spark, sf_dir, F.when(F.col("level") >= 35, 1.0).otherwise(-1.0))
    changes = F.aggregate(F.sequence(F.lit(1), F.size("x") - 1), F.lit(0), lambda n, i: n + (F.get("x", i) != F.get("x", i - 1)).cast("int"))
    held = F.flatten(F.transform("x", lambda v: F.array_repeat(v, (8 + F.col("channel") % 5).cast("int"))))
    found = s.where(F.size("x") > 1).where(changes >= 20).select("channel", blind.unit_rate(48_000.0, 0.0, 9_600.0)(held).alias("rate"))
    return found.select("channel", F.round(48_000 / F.col("rate")).cast("int").alias("unit"))


@query(f"WITH {_SEQ} SELECT channel, string_agg(CASE cell % 4 WHEN 0 THEN '00' WHEN 1 THEN '01' WHEN 2 THEN '11' ELSE '10' END, '' ORDER BY k) AS bits FROM o GROUP BY channel HAVING count(DISTINCT cell % 4) = 4 AND count(*) >= 24")
def sliced_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Gray-coded bits of each channel's cells as four noisy levels; channels that have all four and 24 visits."""
    noise = (F.pmod(F.xxhash64("event_id"), F.lit(1000)) - 500) / 2500.0
    s = _series(spark, sf_dir, F.col("cell") % 4 * 0.7 - 0.9 + noise)
    kinds = F.size(F.array_distinct(F.transform("x", lambda v: F.round((v + 0.9) / 0.7))))
    cut = s.where((F.size("x") >= 24) & (kinds == 4)).select("channel", blind.slice_levels(4)("x").alias("s"))
    return cut.select("channel", F.array_join(F.transform("s.bits", lambda b: b.cast("string")), "").alias("bits"))


@query(f"WITH {VISITS_SQL} SELECT channel, true AS flagged, ((200 + channel % 100) * 1000)::BIGINT AS spacing FROM v GROUP BY channel")
def line_combs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spacing, to 1 kHz, of ten lines a channel a few hundred hertz off a grid, among three loose ones."""
    step = (200 + F.col("channel") % 100) * 1000
    off = lambda i, most: F.pmod(F.xxhash64("channel", i), F.lit(2 * most + 1)) - most
    grid = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: (1_000_000 + i * step + off(i, 300)).cast("double"))
    loose = F.transform(F.array(F.lit(2), F.lit(5), F.lit(6)), lambda i: (1_000_000 + (i + 0.3) * step + off(i, 900)).cast("double"))
    frames = spread(visits(spark, sf_dir).select("channel").distinct(), "channel").select("channel", F.concat(grid, loose).alias("f"))
    found = frames.select("channel", blind.combs(0.0, 5e6)("f").alias("c"))
    return found.select("channel", "c.flagged", (F.round(F.col("c.spacing") / 1000) * 1000).cast("long").alias("spacing"))


@query(f"WITH {VISITS_SQL} SELECT tier, true AS reflected, 32 AS width, 79764919::BIGINT AS poly FROM v GROUP BY tier HAVING count(*) >= 20")
def check_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check polynomial of each tier's frames: 24 bytes of a visit and their CRC-32, least byte first."""
    body = F.encode(F.concat(F.lpad(F.hex(F.col("event_id")), 8, "0"), F.lpad(F.hex(F.col("start_us")), 16, "0")), "utf-8")
    sent = visits(spark, sf_dir).select("tier", body.alias("body"), F.lpad(F.hex(F.crc32(body)), 8, "0").alias("c"))
    turned = F.concat(*(F.substring("c", i, 2) for i in (7, 5, 3, 1)))
    frames = sent.select("tier", F.concat("body", F.unhex(turned)).alias("frame"))
    return inference.check_polynomials(frames, ["tier"], "frame").where("n >= 19").select("tier", "reflected", "width", "poly")


@query(f"""WITH {VISITS_SQL}, b AS (SELECT tier, lpad(bin((level * 100)::BIGINT), 16, '0') AS bits FROM v WHERE level < 655),
c AS (SELECT tier, i AS col, substr(bits, i + 1, 1) AS bit FROM b, range(16) t(i)) SELECT tier, col::INT AS "column", count(*)::BIGINT AS n, sum((bit = '1')::INT)::BIGINT AS ones FROM c GROUP BY ALL""")
def bit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each of the 16 bits of a tier's levels (below 655, in hundredths) is 1."""
    level = (F.col("level") * 100).cast("decimal(20,0)").cast("long")
    bits = F.lpad(F.conv(level.cast("string"), 10, 2), 16, "0")
    return inference.column_counts(visits(spark, sf_dir).where("level < 655").select("tier", bits.alias("bits")), ["tier"], "bits", 16)


@query(f"WITH {VISITS_SQL} SELECT tier, 8 + length(tier) AS first, 6 AS width, 8.0 AS scale, 24.0 AS add, count(*)::BIGINT AS n FROM v GROUP BY tier HAVING count(*) >= 20 AND count(DISTINCT cell % 50) > 1")
def length_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length field of each tier's frames: a preamble as long as its name, then 6 bits that count bytes on top of 24 bits."""
    v = F.col("cell") % 50 + 10
    field = F.lpad(F.conv(v.cast("string"), 10, 2), 6, "0")
    fill = F.regexp_replace(F.repeat(F.conv(F.substring(F.md5(F.col("event_id").cast("string")), 1, 15), 16, 2), 10), "[^01]", "")
    head = F.concat(F.repeat(F.lit("1"), 8), F.repeat(F.lit("0"), F.length("tier")))
    body = F.substring(F.concat(head, field, fill), F.lit(1), v * 8 + 24)
    return inference.length_fields(visits(spark, sf_dir).select("tier", body.alias("bits")), ["tier"], "bits", range(24), (4, 5, 6))
