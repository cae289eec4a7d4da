"""Reports, relations and the page queries of the service."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import intervals as I
from spectraloom.operators import joins as J
from spectraloom.operators import relations as R
from spectraloom.plans.observation import DAY, ISLANDS, SPAN
from spectraloom.plans.registry import query
from spectraloom.sources.tables import SPANS_SQL, VISITS_SQL, micros, orders_spans, table, visits

WIDTH = SPAN[1] - SPAN[0]


@query(f"""WITH {VISITS_SQL}, r AS (SELECT cell AS channel, tier, greatest(start_us, {SPAN[0]}) AS start_us, least(end_us, {SPAN[1]}) AS end_us FROM v WHERE cell BETWEEN 0 AND 19),
s AS (SELECT * FROM r WHERE start_us < end_us), {ISLANDS.format(src='s')}, c AS (SELECT channel AS cell, sum(end_us - start_us)::BIGINT AS observed_us, count(*)::BIGINT AS n_visits FROM isl GROUP BY 1),
o AS (SELECT cell, avg((level >= 100)::INT) AS fco, count(DISTINCT channel)::BIGINT AS n_channels FROM v WHERE start_us >= {SPAN[0]} AND start_us < {SPAN[1]} GROUP BY 1), d AS (SELECT unnest(range(20)) AS cell)
SELECT d.cell, coalesce(n_visits, 0)::BIGINT AS n_visits, round(coalesce(observed_us, 0) / {float(WIDTH)}, 9) AS coverage, round(fco, 9) AS fco, coalesce(n_channels, 0)::BIGINT AS n_channels, observed_us IS NULL AS never_observed
FROM d LEFT JOIN c USING (cell) LEFT JOIN o USING (cell)""")
def report_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The region report: coverage, occupancy and inventory of twenty cells, those never observed included."""
    v = visits(spark, sf_dir)
    clipped = v.where("cell between 0 and 19").select("cell", F.greatest("start_us", F.lit(SPAN[0])).alias("lo"), F.least("end_us", F.lit(SPAN[1])).alias("hi")).where("lo < hi")
    cover = I.merge(clipped, ["cell"], "lo", "hi", DAY).groupBy("cell").agg(F.sum(F.col("hi") - F.col("lo")).alias("observed_us"), F.count("*").alias("n_visits"))
    inside = v.where((F.col("start_us") >= SPAN[0]) & (F.col("start_us") < SPAN[1]))
    use = inside.groupBy("cell").agg(F.avg((F.col("level") >= 100).cast("int")).alias("fco"), F.countDistinct("channel").alias("n_channels"))
    out = spark.range(20).withColumnRenamed("id", "cell").join(cover, "cell", "left").join(use, "cell", "left")
    return out.select("cell", F.coalesce("n_visits", F.lit(0)).alias("n_visits"), F.round(F.coalesce("observed_us", F.lit(0)) / float(WIDTH), 9).alias("coverage"), F.round("fco", 9).alias("fco"), F.coalesce("n_channels", F.lit(0)).alias("n_channels"), F.col("observed_us").isNull().alias("never_observed"))


@query(f"""WITH {VISITS_SQL}, x AS (SELECT tier, channel, (cell + 1)::DOUBLE AS n, level + 25.0 * (cell + 1) AS f FROM v WHERE cell IS NOT NULL AND level IS NOT NULL)
SELECT channel, round(regr_slope(f, n), 5) AS spacing, round(regr_intercept(f, n), 4) AS f0, CASE WHEN count(*) > 2 THEN round(sqrt(greatest(regr_syy(f, n) - regr_slope(f, n) * regr_sxy(f, n), 0) / (count(*) - 2)), 4) END AS sigma, count(*)::BIGINT AS n
FROM x GROUP BY channel HAVING count(DISTINCT n) > 1""")
def harmonic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spacing and residual of each channel's lines against their harmonic number."""
    x = visits(spark, sf_dir).where("cell is not null and level is not null").select("channel", (F.col("cell") + 1).alias("n"), (F.col("level") + 25.0 * (F.col("cell") + 1)).alias("f"))
    many = x.groupBy("channel").agg(F.countDistinct("n").alias("k")).where("k > 1").select("channel")
    line = R.harmonic_line(x.join(many, "channel", "left_semi"), ["channel"], "n", "f")
    return line.select("channel", F.round("spacing", 5).alias("spacing"), F.round("offset", 4).alias("f0"), F.round("sigma", 4).alias("sigma"), "n")


@query()
def retune_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each part's price moves with its size within a brand; ordered greedy claims, so no SQL."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 10).alias("centre"), (F.col("p_size") % 5).cast("double").alias("oscillator"))
    return R.retune(p, "p_brand", "p_partkey", "centre", "oscillator", 0.2)


_ALLOC = "a AS (SELECT n_nationkey * 20.0 AS lo, n_nationkey * 20.0 + 30 AS hi, n_name AS service, n_regionkey AS status FROM nation)"


@query(f"""WITH {VISITS_SQL}, {_ALLOC}, j AS (SELECT event_id, level, service, status, row_number() OVER (PARTITION BY event_id ORDER BY status DESC, lo DESC) AS i FROM v LEFT JOIN a ON level >= lo AND level < hi)
SELECT event_id, service, status FROM j WHERE i = 1""")
def allocation_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The allocation of highest status that holds each visit's level; the allocations are one row a nation."""
    a = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 20.0).alias("lo"), (F.col("n_nationkey") * 20.0 + 30).alias("hi"), F.col("n_name").alias("service"), F.col("n_regionkey").alias("status"))
    return R.allocated(visits(spark, sf_dir).select("event_id", "level"), "level", a, "lo", "hi", "status").select("event_id", "service", "status")


@query(f"""WITH {VISITS_SQL}, d AS (SELECT channel, min(start_us) AS f, max(end_us) AS l, count(*) AS n, sum((end_us - start_us) * 0.5) AS o FROM v GROUP BY channel),
k AS (SELECT channel, list(start_us ORDER BY start_us DESC) AS s FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY start_us DESC) AS i FROM v) WHERE i <= 3 GROUP BY channel)
SELECT channel, f::BIGINT AS first, l::BIGINT AS last, n::BIGINT AS appearances, round(least(o / greatest(l - f, 1), 1), 9) AS duty, s[1]::BIGINT AS newest_us FROM d JOIN k USING (channel)""")
def recurrence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each channel came and for how much of the time, at half duty a visit."""
    r = R.recurrence(visits(spark, sf_dir), "channel", "start_us", "end_us", F.lit(0.5), 3)
    return r.select("channel", "first", "last", "appearances", F.round("duty", 9).alias("duty"), F.col("newest")[0].alias("newest_us"))


@query(f"""WITH {VISITS_SQL} SELECT channel, round(count(*) / ((max(start_us) - min(start_us)) / 6e7), 9) AS grants_per_min, count(DISTINCT cell)::BIGINT AS talkgroups FROM v WHERE tier IN ('click', 'view', 'purchase') GROUP BY channel HAVING max(start_us) > min(start_us)""")
def trunk_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grants a minute and distinct talkgroups of each system."""
    g = visits(spark, sf_dir).where(F.col("tier").isin("click", "view", "purchase")).groupBy("channel").agg(F.count("*").alias("n"), F.min("start_us").alias("a"), F.max("start_us").alias("b"), F.countDistinct("cell").alias("talkgroups"))
    return g.where("b > a").select("channel", F.round(F.col("n") / ((F.col("b") - F.col("a")) / 6e7), 9).alias("grants_per_min"), "talkgroups")


@query(f"""WITH {VISITS_SQL}, p AS (SELECT channel, event_id, start_us / 1e6 AS t, level AS f, lag(start_us / 1e6) OVER w AS t0, lag(level) OVER w AS f0, cell AS n FROM v WINDOW w AS (PARTITION BY channel ORDER BY start_us, event_id))
SELECT event_id, round(abs(t - t0), 6) AS dt, round(abs(f - f0), 6) AS df, CASE WHEN t <> t0 THEN round(n / abs(t - t0), 9) END AS rate, CASE WHEN n > 0 THEN round(abs(t - t0) / n, 6) END AS period FROM p WHERE t0 IS NOT NULL""")
def cursor_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two cursors, each visit and the one before it, measure."""
    by = Window.partitionBy("channel").orderBy("start_us", "event_id")
    p = visits(spark, sf_dir).select("event_id", (F.col("start_us") / 1e6).alias("t"), F.col("level").alias("f"), F.lag(F.col("start_us") / 1e6).over(by).alias("t0"), F.lag("level").over(by).alias("f0"), F.col("cell").alias("n"))
    m = p.where("t0 is not null").select("event_id", R.measurement((F.col("t0"), F.col("f0")), (F.col("t"), F.col("f")), F.col("n")).alias("m"))
    return m.select("event_id", F.round("m.dt", 6).alias("dt"), F.round("m.df", 6).alias("df"), F.round("m.rate", 9).alias("rate"), F.round("m.period", 6).alias("period"))


@query(f"""WITH {VISITS_SQL}, b AS (SELECT channel, count(*) AS n FROM v GROUP BY channel) SELECT event_id, CASE WHEN channel % 11 = 0 THEN 'mobile' WHEN cell IS NULL THEN 'unassigned' WHEN tier = 'error' THEN 'provenance' WHEN n < 60 THEN 'immature' END AS reason FROM v JOIN b USING (channel) WHERE level >= 150""")
def suppressed_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High levels with the first reason, if any, to hold an alarm back."""
    v = visits(spark, sf_dir)
    n = v.groupBy("channel").agg(F.count("*").alias("n"))
    reason = R.anomalies_suppressed(F.col("channel") % 11 == 0, F.col("cell").isNull(), F.col("tier") == "error", F.col("n") < 60)
    return v.where("level >= 150").join(n, "channel").select("event_id", reason.alias("reason"))


@query(f"""WITH {VISITS_SQL}, h AS (SELECT channel, start_us, lag(start_us) OVER (PARTITION BY channel ORDER BY start_us) AS p FROM v WHERE level >= 80),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR start_us - p > {DAY} THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start_us ROWS UNBOUNDED PRECEDING) AS g FROM h) SELECT channel, min(start_us)::BIGINT AS first, max(start_us)::BIGINT AS last, count(*)::BIGINT AS n FROM g GROUP BY channel, g""")
def floor_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of raised level, a day or more apart."""
    return R.episodes(visits(spark, sf_dir), "channel", "start_us", "event_id", F.col("level") >= 80, DAY)


@query()
def truth_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of open and finished orders of a customer by nearest life, cheapest first; greedy, so no SQL."""
    s = orders_spans(spark, sf_dir)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    s = s.join(o, F.col("order_id") == F.col("o_orderkey"))
    a = s.where("o_orderstatus = 'O'").select(F.col("order_id").alias("truth"), F.col("customer").alias("c1"), "lo", "hi")
    b = s.where("o_orderstatus = 'F'").select(F.col("order_id").alias("box"), F.col("customer").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    pairs = I.range_join(a, b, [("c1", "c2")], ("lo", "lo2"), ("hi", "hi2"), 60).withColumn("cost", F.abs(F.col("lo") - F.col("lo2")) + F.abs(F.col("hi") - F.col("hi2")))
    return J.greedy_one_to_one(pairs, "truth", "box", "cost")


@query("""WITH t AS (SELECT o_orderkey, o_custkey, o_orderstatus, epoch_us(o_orderdate) AS t FROM orders) SELECT o_orderstatus AS status, o_orderkey, o_custkey FROM t WHERE o_orderstatus IN ('O', 'P') ORDER BY t.t DESC, o_orderkey DESC LIMIT 200""")
def anomaly_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest page of a status filter. The limit is the feature."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"), micros("o_orderdate").alias("t"))
    return o.orderBy(F.desc("t"), F.desc("o_orderkey")).limit(200).select("status", "o_orderkey", "o_custkey")


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*)::BIGINT AS n, round(avg((l_quantity > 25)::INT), 9) AS accuracy, floor(l_discount * 50)::BIGINT AS snr_bin FROM lineitem GROUP BY ALL""")
def accuracy_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement by class and signal bin, never one pooled number."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.floor(F.col("l_discount") * 50).alias("snr_bin")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("l_quantity") > 25).cast("int")), 9).alias("accuracy"))


@query(f"WITH {SPANS_SQL} SELECT customer, order_id, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY customer ORDER BY hi - lo DESC, order_id) AS i FROM spans) WHERE i <= 3")
def bounded_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest lives of each customer: bounded retention."""
    by = Window.partitionBy("customer").orderBy(F.desc(F.col("hi") - F.col("lo")), "order_id")
    return orders_spans(spark, sf_dir).withColumn("i", F.row_number().over(by)).where("i <= 3").select("customer", "order_id", "lo", "hi")
