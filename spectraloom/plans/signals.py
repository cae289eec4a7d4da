"""Queries of array, frame and grid operators over embeddings, events, documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import gamma
from spectraloom.operators import frames as B
from spectraloom.operators import graph as G
from spectraloom.operators import spectral as X
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, table, visits


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE) AS p FROM embeddings), s AS (SELECT vec_id, len(p) AS m, list_sum(p) AS s1, list_sum(list_transform(p, lambda x: x * x)) AS s2, list_max(p) AS mx FROM e)
SELECT vec_id, round(s1 / m, 6) AS mean_power, round(10 * log10(greatest(mx, 1e-30) / (s1 / m)), 4) AS crest_db, round((m + 1) / (m - 1)::DOUBLE * (m * s2 / (s1 * s1) - 1), 6) AS kurtosis FROM s""")
def vec_kurtosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power, crest and kurtosis of each block."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * x.cast("double")).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, x: a + x) / F.size("p")
    return e.select("vec_id", F.round(mean, 6).alias("mean_power"), F.round(10 * F.log10(F.greatest(F.array_max("p"), F.lit(1e-30)) / mean), 4).alias("crest_db"), F.round(X.kurtosis_of_power(F.col("p")), 6).alias("kurtosis"))


_BINS = 16


@query(f"""WITH h AS (SELECT k, 0.5 - 0.5 * cos(2 * pi() * k / {_BINS}) AS w FROM range({_BINS}) t(k)),
e AS (SELECT vec_id, embedding AS x, unnest(range((len(embedding) - {_BINS}) // {_BINS // 2} + 1)) AS j FROM embeddings WHERE len(embedding) >= {_BINS}),
s AS (SELECT vec_id, j, k, x[j * {_BINS // 2} + k + 1]::DOUBLE * w AS y FROM e CROSS JOIN h),
d AS (SELECT vec_id, j, b, pow(sum(y * cos(2 * pi() * (b - {_BINS // 2}) * k / {_BINS})), 2) + pow(sum(y * sin(2 * pi() * (b - {_BINS // 2}) * k / {_BINS})), 2) AS p FROM s CROSS JOIN range({_BINS}) r(b) GROUP BY ALL)
SELECT vec_id, b::INT AS bin, round(avg(p) / (SELECT sum(w * w) FROM h), 6) AS power FROM d GROUP BY ALL""")
def vec_welch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averaged power density of each block over overlapping frames of 16 samples, by bin."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", X.welch(_BINS)("embedding").alias("psd"))
    return e.select("vec_id", F.posexplode("psd").alias("bin", "power")).withColumn("power", F.round("power", 6))


MOST_CLASSES = 4096


def _few(classes: DataFrame, row: DataFrame) -> DataFrame:
    """The one row made of all classes, once it is sure that they are few."""
    if classes.limit(MOST_CLASSES + 1).count() > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes don't travel as one row")
    return row


def _centroids(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    long = e.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.var_samp(F.col("x").cast("double")).alias("v"))
    return e, means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m", "v"))), lambda s: F.struct(s["m"].alias("m"), s["v"].alias("v"))).alias("c"))


_CENT = "l AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label AS k, i, avg(x) AS m, var_samp(x) AS v FROM l GROUP BY ALL)"


@query(f"""WITH {_CENT}, d AS (SELECT vec_id, k, sqrt(sum((x - m) * (x - m))) AS d FROM l JOIN c USING (i) GROUP BY ALL), b AS (SELECT vec_id, min(d) AS d FROM d GROUP BY 1)
SELECT vec_id, round(d, 5) AS distance FROM b""")
def nearest_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each vector to the nearest class mean; the means, one a label, travel as one broadcast row, and no pair is emitted."""
    e, c = _centroids(spark, sf_dir)
    means = c.agg(F.collect_list(F.transform("c", lambda s: s["m"])).alias("means"))
    square = lambda m: F.aggregate(F.zip_with("embedding", m, lambda x, y: F.pow(x.cast("double") - y, 2)), F.lit(0.0), lambda a, x: a + x)
    nearest = F.array_min(F.transform("means", lambda m: F.sqrt(square(m))))
    return e.join(F.broadcast(_few(c, means)), F.lit(True)).select("vec_id", F.round(nearest, 5).alias("distance"))


@query(f"""WITH {_CENT} SELECT vec_id, round(sqrt(sum((x - m) * (x - m) / greatest(v, 1e-9)) / count(*)), 5) AS score, sqrt(sum((x - m) * (x - m) / greatest(v, 1e-9)) / count(*)) > 1.2 AS unknown FROM l JOIN c ON l.label = c.k AND l.i = c.i GROUP BY vec_id""")
def open_set_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each vector is from its own class in units of the class's spread, and whether that is too far."""
    e, c = _centroids(spark, sf_dir)
    terms = F.zip_with("embedding", "c", lambda x, s: F.pow(x.cast("double") - s["m"], 2) / F.greatest(s["v"], F.lit(1e-9)))
    d = F.sqrt(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / F.size("embedding"))
    return e.join(c, "label").select("vec_id", F.round(d, 5).alias("score"), (d > 1.2).alias("unknown"))


@query("""WITH p AS (SELECT vec_id, embedding AS x, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS y FROM embeddings),
l AS (SELECT vec_id, x, y, unnest(range(-4, 5)) AS lag FROM p WHERE y IS NOT NULL), z AS (SELECT vec_id, lag, x, y, unnest(range(greatest(lag, 0), len(x) + least(lag, 0))) AS i FROM l),
c AS (SELECT vec_id, lag, corr(x[i + 1]::DOUBLE, y[i - lag + 1]::DOUBLE) AS r FROM z GROUP BY ALL)
SELECT vec_id, lag::INT AS lag, round(coalesce(r, 0), 6) AS correlation FROM c QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(coalesce(r, 0), 9) DESC, lag) = 1""")
def vec_xcorr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lag and size of the best correlation of each block with the next of its label.

    Only ids go through the window that finds the next one; the vectors meet by a join.
    """
    e = table(spark, sf_dir, "embeddings")
    follows = e.select("vec_id", F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("next")).where("next is not null")
    pairs = follows.join(e.select("vec_id", "embedding"), "vec_id").join(e.select(F.col("vec_id").alias("next"), F.col("embedding").alias("other")), "next")
    return pairs.select("vec_id", X.best_lag(4)("embedding", "other").alias("r")).select("vec_id", "r.lag", F.round("r.correlation", 6).alias("correlation"))


@query(f"""WITH {VISITS_SQL}, n AS (SELECT *, list_sort(list_concat(coalesce(list(level) OVER (PARTITION BY channel ORDER BY start_us, event_id ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING), []),
  coalesce(list(level) OVER (PARTITION BY channel ORDER BY start_us, event_id ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING), []))) AS near FROM v)
SELECT event_id, near[9] AS level_k FROM n WHERE len(near) >= 9 AND level > 4 * near[9]""")
def cfar_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits above four times the ninth smallest of the sixteen around them."""
    return X.ordered_cfar(visits(spark, sf_dir), ["channel"], "start_us", "event_id", "level", 8, 9, 4.0).select("event_id", "level_k")


@query(f"""WITH {VISITS_SQL}, m AS (SELECT channel, median(level) AS m FROM v GROUP BY 1), d AS (SELECT v.*, m, abs(level - m) AS d FROM v JOIN m USING (channel)), s AS (SELECT channel, median(d) AS s FROM d GROUP BY 1)
SELECT event_id, channel FROM d JOIN s USING (channel) WHERE level > m + 3 * 1.4826 * s""")
def impulse_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits far above their channel's median in units of its median deviation."""
    return X.robust_bursts(visits(spark, sf_dir), ["channel"], "start_us", "level", 3.0).select("event_id", "channel")


@query(f"WITH {VISITS_SQL}, p AS (SELECT event_id, ((event_id * 123456789) % 4294967296) / 4294967296.0::DOUBLE * {6.283185307179586} AS p FROM v) SELECT event_id, round(cos(p), 9) AS i, round(sin(p), 9) AS q FROM p")
def oscillator_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, q = X.oscillator(F.col("event_id"), 123456789)
    return visits(spark, sf_dir).select("event_id", F.round(i, 9).alias("i"), F.round(q, 9).alias("q"))


_RASTER = "avg(cos(level / 12.5 * 6.283185307179586)) AS c, avg(sin(level / 12.5 * 6.283185307179586)) AS s"


@query(f"""WITH {VISITS_SQL}, t AS (SELECT tier, {_RASTER}, sqrt((avg(level * level) - avg(level) * avg(level)) / (avg(level) * avg(level))) AS s4 FROM v GROUP BY tier)
SELECT tier, round(((atan2(s, c) / 6.283185307179586 * 12.5) % 12.5 + 12.5) % 12.5, 6) AS raster_offset, round(sqrt(c * c + s * s), 6) AS agreement, round(s4, 6) AS s4 FROM t""")
def raster_and_scintillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset of each tier's levels on a raster of 12.5, its agreement, and the scintillation index."""
    offset, agreement = X.raster_offset(F.col("level"), 12.5)
    return visits(spark, sf_dir).groupBy("tier").agg(F.round(offset, 6).alias("raster_offset"), F.round(agreement, 6).alias("agreement"), F.round(X.scintillation(F.col("level")), 6).alias("s4"))


_GRID = "h AS (SELECT DISTINCT cell AS x, start_us // 86400000000 - 19723 AS y FROM v WHERE level >= 100 AND cell IS NOT NULL)"


@query(f"""WITH RECURSIVE {VISITS_SQL}, {_GRID}, n AS (SELECT x, y, y * 100 + x AS id FROM h),
e AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON (a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1)),
r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT n.x, n.y::BIGINT AS y, min(r.b)::BIGINT AS label FROM n JOIN r ON n.id = r.a GROUP BY n.x, n.y""")
def grid_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """4-connected groups of occupied cells over cell and day (from 2024-01-01)."""
    hot = visits(spark, sf_dir).where("level >= 100 and cell is not null").select(F.col("cell").alias("x"), (F.floor(F.col("start_us") / 86_400_000_000) - 19723).alias("y")).distinct()
    return G.label_cells(hot, "x", "y", 100)


@query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, unnest(regexp_extract_all(h, '..')) AS x FROM b),
c AS (SELECT doc_id, x, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM c) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id""")
def payload_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits of entropy of every payload's bytes."""
    return table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", F.round(B.byte_entropy()("text"), 6).alias("entropy"))


@query("""WITH b AS (SELECT page_id, url, list_transform(range(1, length(url) + 1), lambda i: ascii(substr(url, i, 1))) AS v FROM pages WHERE regexp_full_match(url, '[\\x20-\\x7E]+'))
SELECT page_id, (list_sum(v) % 256)::INT AS add8, list_reduce(v, lambda a, x: xor(a, x))::INT AS xor8 FROM b""")
def frame_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum and exclusive-or checks of every ASCII url as a frame."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^[\x20-\x7E]+$"))
    v = B.byte_values(F.col("url"))
    return p.select("page_id", B.add_checksum(v).alias("add8"), B.xor_checksum(v).alias("xor8"))


_OCTETS = "list_transform(regexp_extract_all(hex(encode(url)), '..'), lambda x: ('0x' || x)::BIGINT)"


@query(f"SELECT page_id, {B.crc_sql('crc32', _OCTETS)}::BIGINT AS crc32, {B.crc_sql('crc16-x25', _OCTETS)}::BIGINT AS crc16, {B.crc_sql('crc24-adsb', _OCTETS)}::BIGINT AS crc24 FROM pages")
def frame_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every url as a frame, CRC-32 by the built-in and others by table."""
    p = table(spark, sf_dir, "pages").withColumn("raw", F.col("url").cast("binary"))
    return p.select("page_id", F.crc32("raw").alias("crc32"), B.crc("crc16-x25")("raw").alias("crc16"), B.crc("crc24-adsb")("raw").alias("crc24"))


@query("""WITH b AS (SELECT page_id, hex(encode(url)) AS h FROM pages WHERE url IS NOT NULL), n AS (SELECT page_id, ('0x' || substr(h, 1, 14))::BIGINT AS x FROM b WHERE length(h) >= 14)
SELECT page_id, ((x >> 52) & 15)::BIGINT AS kind, ((x >> 40) & 4095)::BIGINT AS address, ((x >> 24) & 65535)::BIGINT AS word, ((x >> 21) & 7)::BIGINT AS flags FROM n""")
def field_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared field map read from every url's first bytes."""
    fields = [("kind", 0, 4), ("address", 4, 12), ("word", 16, 16), ("flags", 32, 3)]
    p = table(spark, sf_dir, "pages").withColumn("raw", F.col("url").cast("binary")).where(F.octet_length("raw") >= 7)
    return p.select("page_id", B.parse_fields(F.col("raw"), fields).alias("f")).select("page_id", "f.*")


@query("""WITH b AS (SELECT page_id, hex(encode(url)) AS h FROM pages WHERE url IS NOT NULL), u AS (SELECT page_id, i, ('0x' || substr(h, 2 * i::INT + 1, 8))::BIGINT AS w FROM (SELECT page_id, h, unnest(range(length(h) // 2 - 3)) AS i FROM b))
SELECT page_id, i::INT AS at FROM u WHERE bit_count(xor(w, 1702388084)) <= 4""")
def sync_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in every url's bytes of a 32-bit word with at most four wrong bits."""
    p = table(spark, sf_dir, "pages").where("url is not null")
    return p.select("page_id", F.explode(B.find_sync(F.col("url").cast("binary"), 0x65786174, 4, 4)).alias("at"))


@query("""SELECT o_orderkey, sha256('{"custkey":"' || o_custkey || '","priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS hash FROM orders""")
def canonical_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of each order's attributes as JSON with sorted keys."""
    o = table(spark, sf_dir, "orders")
    pairs = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("custkey"), F.col("o_custkey").cast("string"), F.lit("priority"), F.col("o_orderpriority"))
    return o.select("o_orderkey", B.canonical_hash(pairs).alias("hash"))


@query("""WITH l AS (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
SELECT label, i::INT AS bin, round(max(x)::DOUBLE, 6) AS max_hold, round(min(x)::DOUBLE, 6) AS min_hold, round(avg(x::DOUBLE), 6) AS mean FROM l GROUP BY label, i""")
def vec_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximum, minimum and mean of each bin over the blocks of a label."""
    h = X.holds(table(spark, sf_dir, "embeddings").select("label", "embedding"), ["label"], "embedding")
    return h.select("label", "bin", F.round(F.col("max_hold").cast("double"), 6).alias("max_hold"), F.round(F.col("min_hold").cast("double"), 6).alias("min_hold"), F.round("mean", 6).alias("mean"))


@query("""WITH c AS (SELECT vec_id, label, len(list_filter(embedding, lambda x: abs(x) >= 0.25)) AS n FROM embeddings), w AS (SELECT *, sum((n >= 2)::INT) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS h FROM c)
SELECT vec_id, n::INT AS clipped, n >= 2 AND h >= 2 AS overload FROM w""")
def overload_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped samples of each block and whether its label's front end is overloaded."""
    c = table(spark, sf_dir, "embeddings").select("vec_id", "label", X.clipped(F.col("embedding"), 0.25).alias("clipped"))
    return X.overloaded(c, ["label"], "vec_id", "clipped", 2, 3, 2).select("vec_id", "clipped", "overload")


@query(f"""WITH {VISITS_SQL}, x AS (SELECT channel, (start_us - 1704067200000000) / 3.6e9 AS t, level AS f FROM v)
SELECT channel, round(regr_slope(f, t), 6) AS rate, round(regr_r2(f, t), 6) AS r2, count(*)::BIGINT AS n FROM x GROUP BY channel HAVING count(DISTINCT t) > 1 AND count(DISTINCT f) > 1""")
def drift_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each channel's level over time, as of a chirp."""
    x = visits(spark, sf_dir).select("channel", ((F.col("start_us") - 1704067200000000) / 3.6e9).alias("t"), F.col("level").alias("f"))
    enough = x.groupBy("channel").agg(F.countDistinct("t").alias("k"), F.countDistinct("f").alias("m")).where("k > 1 and m > 1").select("channel")
    r = X.chirp_rate(x.join(enough, "channel", "left_semi"), ["channel"], "t", "f")
    return r.select("channel", F.round("rate", 6).alias("rate"), F.round("r2", 6).alias("r2"), "n")


_DENSE = f"""{_CENT}, g AS (SELECT vec_id, any_value(l.label) AS label, k, sum((x - m) * (x - m) / greatest(v, 1e-9)) AS d2, count(*) AS n, -0.5 * sum((x - m) * (x - m) / greatest(v, 1e-9) + ln(greatest(v, 1e-9))) AS density FROM l JOIN c USING (i) GROUP BY vec_id, k)"""


@query(f"""WITH {_DENSE}, b AS (SELECT vec_id, k AS best, d2, n FROM g QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(density, 9) DESC, k) = 1),
t AS (SELECT vec_id, best, d2, n, unnest(range(n // 2)) AS j FROM b)
SELECT vec_id, best, round(sum(exp(-d2 / 2 + j * ln(d2 / 2) - lgamma(j + 1))), 6) AS open_set FROM t GROUP BY vec_id, best""")
def density_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of highest density with a diagonal covariance, and the chi-square tail of the vector's distance to it.

    The classes' means and spreads, one row a label, travel as one broadcast row.
    """
    e, c = _centroids(spark, sf_dir)
    models = c.agg(F.collect_list(F.struct("label", "c")).alias("models"))
    spread = lambda s: F.greatest(s["v"], F.lit(1e-9))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    terms = lambda m: F.zip_with("embedding", m["c"], lambda x, s: F.pow(x.cast("double") - s["m"], 2) / spread(s))
    scored = F.transform("models", lambda m: F.struct(F.round(-0.5 * (total(terms(m)) + total(F.transform(m["c"], lambda s: F.ln(spread(s))))), 9).alias("density"), (-m["label"]).alias("rank"), total(terms(m)).alias("d2")))
    best = e.join(F.broadcast(_few(c, models)), F.lit(True)).select("vec_id", F.size("embedding").alias("k"), F.array_max(scored).alias("b"))
    tail = gamma.column(gamma.chi_square_tail, F.col("b.d2"), F.col("k").cast("double"))
    return best.select("vec_id", (-F.col("b.rank")).alias("best"), F.round(tail, 6).alias("open_set"))


@query()
def noise_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looks that the spread of each channel's decibels tells of, and what its median then reads above the mean; by bisection, so no SQL."""
    v = visits(spark, sf_dir).groupBy("channel").agg(F.var_samp(F.col("level") / 10).alias("variance"))
    shape = gamma.column(gamma.shape_of_db_variance, F.col("variance"))
    out = v.select("channel", "variance", shape.alias("looks"))
    return out.withColumn("median_bias_db", F.round(gamma.column(gamma.percentile_bias_db, F.col("looks"), F.lit(0.5)), 6)).withColumn("looks", F.round("looks", 6))
