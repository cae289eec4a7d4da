"""Pyramid tiles with histograms, from the table and from the log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.operators import tiles as T
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, visits
from spectraloom.streaming.live import event_stream
from spectraloom.streaming.tiles import drained_tiles

HOUR = 3_600_000_000
BINS = T.Bins(0.0, 0.5, 100)
_LATE = 6 * HOUR
_CELLS = """b0 AS (SELECT cell AS f, start_us // 3600000000 AS t, level, (end_us - start_us) / 1e6 AS s, least(greatest(floor(level / 10 / 0.5), 0), 99)::INT AS bin FROM v),
c0 AS (SELECT f, t, count(*) AS n, max(level / 10) AS max_db, sum(pow(10, level / 100)) AS power, sum(s) AS cover_s, sum(CASE WHEN level >= 100 THEN s ELSE 0 END) AS occupied_s FROM b0 GROUP BY ALL),
p0 AS (SELECT *, coalesce(least(occupied_s / nullif(cover_s, 0), 1), 0) AS max_share FROM c0)"""
_OUT = "max_db, round(power, 3) AS power, round(cover_s, 6) AS cover_s, round(occupied_s, 6) AS occupied_s, round(max_share, 9) AS max_share"


def _percentile(name: str, by: str, q: float) -> str:
    """SQL of the first bin that reaches a share of a cell's counts."""
    return f"""{name} AS (SELECT f, t, 0.5 * (bin + greatest(0, total * {q} - (upto - n)) / n) AS {name} FROM (
      SELECT f, t, bin, n, sum(n) OVER (PARTITION BY f, t ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY f, t) AS total FROM {by}) WHERE upto >= total * {q} QUALIFY row_number() OVER (PARTITION BY f, t ORDER BY bin) = 1)"""


def _shown(cells: DataFrame) -> list:
    places = {"power": 3, "cover_s": 6, "occupied_s": 6, "max_share": 9}
    return ["f", F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"), "max_db", *(F.round(c, k).alias(c) for c, k in places.items())]


def _partial(visited: DataFrame) -> DataFrame:
    v = visited.withColumns({"db": F.col("level") / 10, "s": (F.col("end_us") - F.col("start_us")) / 1e6})
    return T.partial_cells(v, F.col("cell"), F.floor(F.col("start_us") / HOUR), "db", F.col("s"), F.col("level") >= 100, BINS)


@query(f"""WITH {VISITS_SQL}, {_CELLS},
p1 AS (SELECT floor(f / 4)::BIGINT AS f, floor(t / 6)::BIGINT AS t, sum(n) AS n, max(max_db) AS max_db, sum(power) AS power, sum(cover_s) / 4 AS cover_s,
  coalesce(max(occupied_s / nullif(cover_s, 0)), 0) * sum(cover_s) / 4 AS occupied_s, max(max_share) AS max_share FROM p0 GROUP BY 1, 2),
h1 AS (SELECT floor(f / 4)::BIGINT AS f, floor(t / 6)::BIGINT AS t, bin, count(*) AS n FROM b0 GROUP BY ALL), {_percentile('p10', 'h1', 0.1)}, {_percentile('p90', 'h1', 0.9)}
SELECT f, t, n::BIGINT AS n, {_OUT}, round(p10, 6) AS p10, round(p90, 6) AS p90 FROM p1 JOIN p10 USING (f, t) JOIN p90 USING (f, t)""")
def pyramid_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fold up, four cells by six hours: a child tile is six hours long, so its histogram is carried and gives percentiles."""
    level = T.fold_tiles(T.with_shares(_partial(visits(spark, sf_dir))), 4, 6, 6)
    p = {f"p{q}": F.round(T.hist_percentile(F.col("hist"), q, BINS), 6).alias(f"p{q}") for q in (10, 90)}
    return level.select(*_shown(level), *p.values())


@query(f"""WITH {VISITS_SQL}, {_CELLS}, h0 AS (SELECT f, t, bin, count(*) AS n FROM b0 GROUP BY ALL), {_percentile('p50', 'h0', 0.5)}
SELECT f, t::BIGINT AS t, n::BIGINT AS n, {_OUT}, round(p50, 6) AS p50, (t + 1) * {HOUR} <= (SELECT max(start_us) FROM v) - {_LATE} AS sealed FROM p0 JOIN p50 USING (f, t)""")
def stream_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-0 tiles of the log as a stream, late rows merged into what was sealed."""
    e = event_stream(spark, sf_dir).withColumns({"cell": F.get_json_object("props", "$.k").cast("long"), "start_us": F.unix_micros("ts")})
    e = e.withColumn("end_us", F.col("start_us") + (F.floor("level") + 60) * 1_000_000)
    found = T.with_shares(drained_tiles(e, _partial, "start_us", HOUR, _LATE).tiles())
    return found.select(*_shown(found), F.round(T.hist_percentile(F.col("hist"), 50, BINS), 6).alias("p50"), "sealed")
