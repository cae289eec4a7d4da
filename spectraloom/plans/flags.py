"""Queries of filters, flags, class maps and agreement over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectraloom.functions import rules as U
from spectraloom.operators import frames as B
from spectraloom.operators import intervals as I
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, table, visits

#: Spurs (low, high, gain) of the example. Fixed values.
SPURS = [(100.0, 101.0, None), (250.0, 260.0, 20.0)]


@query(f"""WITH {VISITS_SQL}, d AS (SELECT event_id, level AS f, (cell % 7)::DOUBLE AS w, cell * 1.0 AS gain, round(level / 10) * 10 AS h, round(level / 48) * 48 AS c FROM v WHERE level IS NOT NULL AND cell IS NOT NULL)
SELECT event_id, CASE WHEN w <= 3 AND h >= 10 AND abs(f - h) <= greatest(0.05, h * 200e-6) THEN h END AS reference_line, CASE WHEN w <= 3 AND c >= 48 AND abs(f - c) <= 0.5 THEN c END AS clock_line,
  w <= 5 AND f - w / 2 - 1 <= 200 AND 200 <= f + w / 2 + 1 AS dc, f - w / 2 < 80 OR f + w / 2 > 320 AS edge, (f - w / 2 <= 101 AND f + w / 2 >= 100) OR (f - w / 2 <= 260 AND f + w / 2 >= 250 AND abs(gain - 20) <= 1) AS spur FROM d""")
def capture_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-capture flags of every visit as a detection: harmonics of a reference and of the sample clock, the tuned centre, the edges, known spurs."""
    d = visits(spark, sf_dir).where("level is not null and cell is not null").select("event_id", F.col("level").alias("f"), (F.col("cell") % 7).cast("double").alias("w"), F.col("cell").cast("double").alias("gain"))
    f, w, bins = F.col("f"), F.col("w"), F.lit(0.25)
    lo, hi = f - w / 2, f + w / 2
    return d.select(
        "event_id",
        U.reference_harmonic(f, w, bins, 10.0, 200.0, 0.05, 3.0, 1.0).alias("reference_line"),
        U.clock_harmonic(f, w, bins, 48.0, 2.0, 0.1, 3.0, 1.0).alias("clock_line"),
        U.at_tuned_centre(lo, hi, w, F.lit(200.0), 5.0, 1.0).alias("dc"),
        U.in_edge_zone(lo, hi, F.lit(200.0), F.lit(120.0)).alias("edge"),
        U.on_known_spur(lo, hi, F.col("gain"), SPURS).alias("spur"),
    )


@query(f"""WITH {VISITS_SQL}, o AS (SELECT channel, cell // 10 AS tile, CASE WHEN tier = 'error' THEN NULL ELSE tier END AS site FROM v)
SELECT channel, tile, CASE WHEN bool_and(coalesce(site = 'view', false)) THEN 'all' WHEN bool_or(coalesce(site = 'view', false)) THEN 'mixed' ELSE 'none' END AS known, CASE WHEN bool_and(site IS NULL) THEN 'all' WHEN bool_or(site IS NULL) THEN 'mixed' ELSE 'none' END AS unknown FROM o GROUP BY ALL""")
def origin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each tile of a channel stands to a filter on one site, and to one on unrecorded sites (errors record none)."""
    o = visits(spark, sf_dir).select("channel", F.floor(F.col("cell") / 10).alias("tile"), F.when(F.col("tier") != "error", F.col("tier")).alias("site"))
    match = lambda *how: U.match_of_all(U.origin_matches(F.col("site"), *how))
    return o.groupBy("channel", "tile").agg(match("known", "view").alias("known"), match("unknown").alias("unknown"))


@query(f"""WITH {VISITS_SQL} SELECT event_id, channel FROM v WHERE level IS NOT NULL AND cell > 0 AND end_us > start_us AND tier <> 'error' AND NOT coalesce(cell % 13 = 0, false)""")
def path_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that a path may be traced through: with a width (the cell) and a length, no error and no spur (every 13th cell)."""
    v = visits(spark, sf_dir)
    return v.where(U.traceable(F.col("level"), F.col("cell").cast("double"), F.col("start_us"), F.col("end_us"), F.col("tier") == "error", F.col("cell") % 13 == 0)).select("event_id", "channel")


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority AS priority, o_totalprice::DECIMAL(15, 2)::VARCHAR AS price FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(status, '[A-Za-z0-9_.:/@+-]{1,64}') THEN status END AS status, CASE WHEN regexp_full_match(price, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?') THEN price END AS price,
  (3 - coalesce(regexp_full_match(status, '[A-Za-z0-9_.:/@+-]{1,64}'), false)::INT - coalesce(regexp_full_match(price, '-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?'), false)::INT)::INT AS dropped FROM o""")
def sanitised_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's attributes as metadata, of which a policy lets the status (a token) and the price (a number) through."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("price"), F.col("o_totalprice").cast("decimal(15,2)").cast("string")).alias("m"))
    kept, dropped = U.sanitised(F.col("m"), {"status": "token", "price": "number"})
    return o.select("o_orderkey", kept.alias("k"), dropped.alias("dropped")).select("o_orderkey", F.col("k")["status"].alias("status"), F.col("k")["price"].alias("price"), "dropped")


@query(f"""WITH {VISITS_SQL}, b AS (SELECT n_nationkey * 4 AS lo, n_nationkey * 4 + 5 AS hi, n_regionkey AS restriction, n_name AS band FROM nation), s AS (SELECT DISTINCT cell AS lo, cell + 2 AS hi FROM v WHERE cell IS NOT NULL)
SELECT s.lo, s.hi, max(restriction)::INT AS restriction, arg_max(band, (restriction, band)) AS band FROM s JOIN b ON s.lo < b.hi AND s.hi > b.lo GROUP BY ALL""")
def subband_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most restrictive class that any part of each sub-band has in a map of bands."""
    b = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4).cast("long").alias("lo2"), (F.col("n_nationkey") * 4 + 5).cast("long").alias("hi2"), F.col("n_regionkey").alias("restriction"), F.col("n_name").alias("band"))
    s = visits(spark, sf_dir).where("cell is not null").select(F.col("cell").alias("lo"), (F.col("cell") + 2).alias("hi")).distinct()
    met = I.range_join(s, b, [], ("lo", "lo2"), ("hi", "hi2"), 8).where("lo < hi2 and hi > lo2")
    return met.groupBy("lo", "hi").agg(F.max("restriction").alias("restriction"), F.max_by("band", F.struct("restriction", "band")).alias("band"))


@query("""WITH p AS (SELECT l_returnflag AS family, l_linestatus AS model, floor(l_discount * 50)::BIGINT AS snr_bin, CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity > 15 THEN l_returnflag ELSE 'A' END AS answer FROM lineitem)
SELECT model, family, snr_bin, count(*)::BIGINT AS n, count(answer)::BIGINT AS compared, (count(*) FILTER (answer = family))::BIGINT AS agree, CASE WHEN count(answer) > 0 THEN round((count(*) FILTER (answer = family)) / count(answer), 9) END AS agreement FROM p GROUP BY ALL""")
def shadow_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a shadow model agrees with the classical family, by model, family and signal bin; abstentions aren't compared."""
    q = F.col("l_quantity")
    p = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("family"), F.col("l_linestatus").alias("model"), F.floor(F.col("l_discount") * 50).alias("snr_bin"), F.when(q > 40, None).when(q > 15, F.col("l_returnflag")).otherwise("A").alias("answer"))
    return agreement(p, ["model", "family", "snr_bin"], "family", "answer")


def agreement(log: DataFrame, keys: list[str], family: str, answer: str) -> DataFrame:
    agree = F.count_if(F.col(answer) == F.col(family))
    return log.groupBy(*keys).agg(F.count("*").alias("n"), F.count(answer).alias("compared"), agree.alias("agree"), F.when(F.count(answer) > 0, F.round(agree / F.count(answer), 9)).alias("agreement"))


@query("""WITH c AS (SELECT o.o_orderkey, epoch_us(o.o_orderdate) AS t, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_returnflag = 'R') AS available, count(*) OVER () AS total FROM orders o WHERE o_totalprice >= 100000)
SELECT o_orderkey, t::BIGINT AS t, available, total::BIGINT AS total FROM c ORDER BY c.t DESC, o_orderkey DESC LIMIT 100 OFFSET 100""")
def recordings_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of a catalogue, newest first, with each entry's availability and the number of all. The page is the feature."""
    from spectraloom.sources.tables import micros

    o = table(spark, sf_dir, "orders").where("o_totalprice >= 100000").select("o_orderkey", micros("o_orderdate").alias("t"))
    page = o.orderBy(F.desc("t"), F.desc("o_orderkey")).offset(100).limit(100)
    held = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("held")).distinct()
    total = o.agg(F.count("*").alias("total"))
    found = page.join(held, F.col("o_orderkey") == F.col("held"), "left").join(F.broadcast(total), F.lit(True))
    return found.select("o_orderkey", "t", F.col("held").isNotNull().alias("available"), "total")


@query("""WITH u AS (SELECT page_id, url, list_transform(range(1, length(url) + 1), lambda i: ascii(substr(url, i, 1))::HUGEINT) AS v FROM pages WHERE regexp_full_match(url, '[\\x20-\\x7E]+'))
SELECT page_id, lpad(lower(to_hex(list_reduce(list_prepend(14695981039346656037::HUGEINT, v), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0') AS fnv1a,
  (255 - list_reduce(list_prepend(0::HUGEINT, v), lambda a, b: CASE WHEN a + b > 255 THEN a + b - 255 ELSE a + b END))::BIGINT AS ones, regexp_full_match(split_part(split_part(url, '://', 2), '.', 1), '[a-z0-9]([a-z0-9-]{0,62}[a-z0-9])?') AS named FROM u""")
def frame_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 64-bit hash and the ones-complement check of every ASCII url, and whether its first label is a valid identifier."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^[\x20-\x7E]+$"))
    v = B.byte_values(F.col("url"))
    label = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1))
    return p.select("page_id", U.fnv1a(v).alias("fnv1a"), B.ones_complement(v).alias("ones"), U.valid_identifier(label).alias("named"))


@query(f"""WITH {VISITS_SQL}, h AS (SELECT channel, start_us, end_us, level, max(end_us) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM v WHERE level >= 80),
g AS (SELECT *, sum((pe IS NULL OR start_us > pe + 3600000000)::INT) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM h)
SELECT channel, min(start_us)::BIGINT AS start_us, max(end_us)::BIGINT AS end_us, count(*)::BIGINT AS n FROM g GROUP BY channel, g HAVING max(end_us) - min(start_us) >= 120000000""")
def time_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each channel in time: levels above a threshold, held for an hour, of two minutes at least."""
    v = visits(spark, sf_dir).where("level >= 80").withColumn("end_us", F.col("end_us") + 3_600_000_000)
    held = I.merge(v, ["channel"], "start_us", "end_us", 86_400_000_000).withColumn("end_us", F.col("end_us") - 3_600_000_000)
    return held.where("end_us - start_us >= 120000000").select("channel", "start_us", "end_us", "n")
