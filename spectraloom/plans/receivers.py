"""Queries of a receiver's own lines, intercept over a region, quantiles of gaps and snippets over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import intervals as I
from spectraloom.plans.observation import DAY, SPAN
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, table, visits

#: Bins of logarithmic histograms of seconds: the lowest edge, bins a decade, bins. Fixed values.
LOWEST, PER_DECADE, BINS = 1e-5, 8, 64


@query(f"""WITH {VISITS_SQL}, n AS (SELECT count(DISTINCT channel) AS total FROM v) SELECT cell AS line, count(DISTINCT channel)::BIGINT AS channels, round(count(DISTINCT channel) / any_value(total), 9) AS share FROM v, n WHERE cell IS NOT NULL GROUP BY 1 HAVING count(DISTINCT channel) >= 0.3 * any_value(total)""")
def receiver_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that at least three channels in ten show: they are the receiver's own."""
    v = visits(spark, sf_dir)
    total = v.agg(F.count_distinct("channel").alias("total"))
    lines = v.where("cell is not null").select(F.col("cell").alias("line"), "channel").distinct().groupBy("line").agg(F.count("*").alias("channels"))
    return lines.crossJoin(F.broadcast(total)).where("channels >= 0.3 * total").select("line", "channels", F.round(F.col("channels") / F.col("total"), 9).alias("share"))


def _share_sql(lead: int) -> str:
    n = f"p{lead}"
    return f"""w{n} AS (SELECT k, greatest(start_us - {lead}, {SPAN[0]}) AS a, least(end_us, {SPAN[1]}) AS b FROM c WHERE greatest(start_us - {lead}, {SPAN[0]}) < least(end_us, {SPAN[1]})),
o{n} AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM w{n}), g{n} AS (SELECT *, sum((pb IS NULL OR a > pb)::INT) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM o{n}),
i{n} AS (SELECT k, max(b) - min(a) AS us FROM g{n} GROUP BY k, g), {n} AS (SELECT k, sum(us) / {float(SPAN[1] - SPAN[0])} AS {n} FROM i{n} GROUP BY k)"""


HOUR6 = 21_600_000_000


@query(f"""WITH {VISITS_SQL}, c AS (SELECT start_us, end_us, unnest(range(ceil(cell / 5)::BIGINT, cell // 5 + 2)) AS k FROM v WHERE cell IS NOT NULL AND level > 150), {_share_sql(0)}, {_share_sql(HOUR6)},
r AS (SELECT k, coalesce(p0, 0) AS o, coalesce(p{HOUR6}, 0) AS p, p0.k IS NOT NULL AS seen FROM range(0, 24) t(k) LEFT JOIN p0 USING (k) LEFT JOIN p{HOUR6} USING (k))
SELECT count(*)::BIGINT AS cells, count_if(seen)::BIGINT AS observed_cells, round(avg(o), 9) AS observed, round(avg(p), 9) AS poi, round(min(p), 9) AS poi_min FROM r""")
def region_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of a region of 24 equal cells is observed, and the chance to meet an event of six hours in it; cells never observed count as nothing.

    A visit covers the extent of ten from its lattice point on, and a region's cell only as a whole.
    """
    v = visits(spark, sf_dir).where("cell is not null and level > 150")
    whole = F.sequence(F.ceil(F.col("cell") / 5), F.floor(F.col("cell") / 5) + 1)
    c = v.select("start_us", "end_us", F.explode(whole).alias("k"))
    share = lambda lead, name: I.intercept_share(c, ["k"], "start_us", "end_us", lead, *SPAN, DAY).withColumnRenamed("poi", name)
    cells = spark.range(24).withColumnRenamed("id", "k")
    r = cells.join(share(0, "o"), "k", "left").join(share(HOUR6, "p"), "k", "left")
    filled = lambda x: F.coalesce(x, F.lit(0.0))
    return r.agg(F.count("*").alias("cells"), F.count("o").alias("observed_cells"), F.round(F.avg(filled("o")), 9).alias("observed"), F.round(F.avg(filled("p")), 9).alias("poi"), F.round(F.min(filled("p")), 9).alias("poi_min"))


@query(f"""WITH {VISITS_SQL}, d AS (SELECT channel, (start_us - lag(start_us) OVER (PARTITION BY channel ORDER BY start_us, event_id)) / 1e6 AS s FROM v), h AS (SELECT channel, CASE WHEN s <= {LOWEST} THEN 0 ELSE least(floor(log10(s / {LOWEST}) * {PER_DECADE}), {BINS - 1}) END::INT AS bin, count(*) AS n FROM d WHERE s IS NOT NULL GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY channel ORDER BY bin) AS c, sum(n) OVER (PARTITION BY channel) AS t FROM h)
SELECT channel, round({LOWEST} * pow(10, (min(bin) FILTER (c >= greatest(ceil(0.5 * t), 1)) + 0.5) / {PER_DECADE}), 6) AS p50, round({LOWEST} * pow(10, (min(bin) FILTER (c >= greatest(ceil(0.9 * t), 1)) + 0.5) / {PER_DECADE}), 6) AS p90 FROM c GROUP BY 1""")
def gap_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and ninth decile of each channel's gaps between starts, as the middle of their bins in a logarithmic histogram."""
    by = Window.partitionBy("channel").orderBy("start_us", "event_id")
    d = visits(spark, sf_dir).withColumn("s", (F.col("start_us") - F.lag("start_us").over(by)) / 1e6)
    q = log_quantiles(d, ["channel"], "s", {"p50": 0.5, "p90": 0.9}, LOWEST, PER_DECADE, BINS)
    return q.withColumns({n: F.round(n, 6) for n in ("p50", "p90")})


def log_quantiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float], lowest: float, per_decade: int, bins: int) -> DataFrame:
    """keys and a column for each share; nulls don't count, values beyond the ends fall into the end bins."""
    x = F.col(value)
    place = F.when(x <= lowest, 0).otherwise(F.least(F.floor(F.log10(x / lowest) * per_decade), F.lit(bins - 1))).cast("int")
    h = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys)
    run = h.withColumns({"__c": F.sum("n").over(by.orderBy("bin")), "__t": F.sum("n").over(by)})
    first = lambda q: F.min(F.when(F.col("__c") >= F.greatest(F.ceil(F.col("__t") * q), F.lit(1)), F.col("bin")))
    return run.groupBy(*keys).agg(*((lowest * F.pow(F.lit(10.0), (first(q) + 0.5) / per_decade)).alias(n) for n, q in shares.items()))


def snippets(blocks: DataFrame, boxes: DataFrame, block: str, samples: str, size: int, box: list[str], lo: str, hi: str) -> DataFrame:
    """box, samples: the samples [lo, hi) of a recording in numbered blocks of ``size``; what isn't recorded is left out.

    A box finds its blocks by their numbers, so this is an equal join; what is gathered is one box's samples.
    """
    wanted = boxes.where(F.col(lo) < F.col(hi)).select(*box, lo, hi, F.explode(F.sequence(F.floor(F.col(lo) / size), F.floor((F.col(hi) - 1) / size))).alias(block))
    start = F.col(block) * size
    a = F.greatest(F.col(lo) - start, F.lit(0)).cast("int")
    b = F.least(F.col(hi) - start, F.lit(size)).cast("int")
    part = wanted.join(blocks.select(block, samples), block).select(*box, block, F.slice(samples, a + 1, b - a).alias(samples))
    return part.groupBy(*box).agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(block, samples))), lambda p: p[samples])).alias(samples))


def normalised(x: Column) -> Column:
    """An array without its mean and of power one; a flat one becomes zeros."""
    n = F.nullif(F.size(x), F.lit(0))
    bind = lambda value, body: F.get(F.transform(F.array(value), body), F.lit(0))  # noqa: E731  (a value is worked out once)
    total = lambda y, of: F.aggregate(y, F.lit(0.0), lambda s, v: s + of(v)) / n
    free = bind(total(x, lambda v: v), lambda m: F.transform(x, lambda v: v - m))
    scaled = lambda y: bind(F.sqrt(total(y, lambda v: v * v)), lambda r: F.transform(y, lambda v: F.when(r > 0, v / r).otherwise(0.0)))
    return bind(free, scaled)


@query("""WITH b AS (SELECT vec_id * 64 + generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x FROM embeddings), q AS (SELECT vec_id AS box, vec_id * 50 + label * 3 AS lo, vec_id * 50 + label * 3 + 30 + vec_id % 100 AS hi FROM embeddings),
s AS (SELECT box, i, x FROM q JOIN b ON i >= lo AND i < hi), m AS (SELECT box, avg(x) AS m, stddev_pop(x) AS d FROM s GROUP BY 1)
SELECT box, count(*)::BIGINT AS n, round(arg_min((x - m) / d, i), 5) AS first, round(arg_max((x - m) / d, i), 5) AS last, round(max((x - m) / d), 5) AS peak FROM s JOIN m USING (box) GROUP BY 1""")
def box_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of many boxes cut from a recording in blocks of 64, brought to mean nothing and power one: how many, the first, the last, the greatest."""
    e = table(spark, sf_dir, "embeddings")
    boxes = e.select(F.col("vec_id").alias("box"), (F.col("vec_id") * 50 + F.col("label") * 3).alias("lo"), (F.col("vec_id") * 50 + F.col("label") * 3 + 30 + F.col("vec_id") % 100).alias("hi"))
    got = snippets(e.select("vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("x")), boxes, "vec_id", "x", 64, ["box"], "lo", "hi")
    y = got.select("box", normalised(F.col("x")).alias("y"))
    return y.select("box", F.size("y").cast("long").alias("n"), F.round(F.get("y", F.lit(0)), 5).alias("first"), F.round(F.element_at("y", -1), 5).alias("last"), F.round(F.array_max("y"), 5).alias("peak"))
