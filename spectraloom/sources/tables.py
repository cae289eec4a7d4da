"""The driver's tables as signal records.

``events`` is read as an observation log: a user is a channel, an event type a tier, the value a level, ``props.k`` a
frequency cell. Times are whole microseconds since 1970 in UTC, as BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SECOND = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(c) -> F.Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone is."""
    c = F.col(c) if isinstance(c, str) else c
    seconds = F.unix_date(c.cast("date")).cast("long") * 86_400 + F.hour(c) * 3_600 + F.minute(c) * 60
    return seconds * SECOND + (F.extract(F.lit("SECOND"), c) * SECOND).cast("long")


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, channel, tier, level, cell, start_us, end_us: each event occupies 60 s and a second for each unit of its value."""
    start = micros("ts")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("user_id").alias("channel"),
        F.col("event_type").alias("tier"),
        F.col("value").alias("level"),
        F.get_json_object("props", "$.k").cast("long").alias("cell"),
        start.alias("start_us"),
        (start + (F.floor("value") + 60) * SECOND).alias("end_us"),
    )


#: The same in SQL.
VISITS_SQL = """v AS (SELECT event_id, user_id AS channel, event_type AS tier, value AS level, (props->>'$.k')::BIGINT AS cell,
  epoch_us(ts) AS start_us, epoch_us(ts) + (floor(value)::BIGINT + 60) * 1000000 AS end_us FROM events)"""


def orders_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_id, customer, lo, hi: an order's life in days from its date to its last shipment."""
    line = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    orders = table(spark, sf_dir, "orders")
    return orders.join(line, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer"), day("o_orderdate").alias("lo"), F.greatest(day("o_orderdate"), day("shipped")).alias("hi")
    )


SPANS_SQL = """spans AS (SELECT o_orderkey AS order_id, o_custkey AS customer, (o_orderdate::DATE - DATE '1970-01-01')::INT AS lo,
  greatest((o_orderdate::DATE - DATE '1970-01-01'), (shipped::DATE - DATE '1970-01-01'))::INT AS hi
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey)"""
