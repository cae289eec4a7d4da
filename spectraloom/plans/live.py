"""The streaming operators as queries: the whole log as a stream, run until it is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spectraloom.plans.inference import _STATE
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL
from spectraloom.streaming import live as L


@query(f"WITH {VISITS_SQL} SELECT channel, ((start_us // 900000000) * 900000000)::BIGINT AS t_us, count(*)::BIGINT AS n, sum((level >= 100)::INT)::BIGINT AS n_occupied FROM v GROUP BY ALL")
def stream_occupancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy by quarter of an hour from the stream; each batch writes the windows it changed."""
    return L.drained(L.tumbling_occupancy(L.event_stream(spark, sf_dir)), "occupancy", "update", ("channel", "t_us"))


@query(f"""WITH {VISITS_SQL}, w AS (SELECT tier, level, unnest([start_us // 3600000000, start_us // 3600000000 - 1]) * 3600000000 AS t FROM v)
SELECT tier, t::BIGINT AS t_us, count(*)::BIGINT AS n, max(level) AS max_db FROM w GROUP BY ALL""")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows each hour."""
    return L.drained(L.sliding_level(L.event_stream(spark, sf_dir)), "sliding", "update", ("tier", "t_us"))


@query(f"""WITH {VISITS_SQL}, l AS (SELECT *, lag(start_us) OVER (PARTITION BY channel ORDER BY start_us) AS p FROM v),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us - p >= 21600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT channel, min(start_us)::BIGINT AS first, max(start_us)::BIGINT AS last, count(*)::BIGINT AS n FROM g GROUP BY channel, g""")
def stream_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presence closed by six idle hours."""
    return L.drained_presence(L.event_stream(spark, sf_dir)).drop("closed")


@query(f"WITH RECURSIVE {VISITS_SQL}, o AS (SELECT channel, start_us, event_id, level / 100 AS x, row_number() OVER (PARTITION BY channel ORDER BY start_us, event_id) AS rn FROM v), {_STATE} SELECT event_id, channel, step FROM st")
def stream_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm state machine as a stateful stream whose rows may come up to a day late."""
    return L.drained_alarms(L.event_stream(spark, sf_dir)).select("event_id", "channel", "step")
