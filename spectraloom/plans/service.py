"""Further queries of the service: disclosure, watches, panes, clusters, frame inference, provenance and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import clusters as C
from spectraloom.operators import frames as B
from spectraloom.operators import intervals as I
from spectraloom.operators import relations as R
from spectraloom.plans.observation import DAY, ISLANDS, SPAN
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, micros, table, visits


@query(f"""WITH {VISITS_SQL}, r AS (SELECT cell AS channel, tier, greatest(start_us, {SPAN[0]}) AS start_us, least(end_us, {SPAN[1]}) AS end_us FROM v WHERE cell IS NOT NULL),
s AS (SELECT * FROM r WHERE start_us < end_us), {ISLANDS.format(src='s')},
mr AS (SELECT channel, CASE WHEN count(*) > 1 THEN (max(start_us) - min(start_us)) / (count(*) - 1) END AS r FROM isl GROUP BY 1), t AS (SELECT coalesce(2 * avg(r), {(SPAN[1] - SPAN[0]) / 2}) AS t FROM mr),
gp AS (SELECT channel, coalesce(lag(end_us) OVER (PARTITION BY channel ORDER BY start_us), {SPAN[0]}) AS gap_lo, start_us AS gap_hi FROM isl UNION ALL SELECT channel, max(end_us), {SPAN[1]} FROM isl GROUP BY channel)
SELECT channel AS cell, count(*)::BIGINT AS long_gaps, max(gap_hi - gap_lo)::BIGINT AS longest_us FROM gp, t WHERE gap_hi - gap_lo >= t GROUP BY channel""")
def coverage_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps of each cell that are longer than twice the mean of the cells' mean revisits (half the span, if none has two visits)."""
    v = visits(spark, sf_dir).where("cell is not null").select("cell", F.greatest("start_us", F.lit(SPAN[0])).alias("lo"), F.least("end_us", F.lit(SPAN[1])).alias("hi")).where("lo < hi")
    islands = I.merge(v, ["cell"], "lo", "hi", DAY)
    revisit = islands.groupBy("cell").agg(F.when(F.count("*") > 1, (F.max("lo") - F.min("lo")) / (F.count("*") - 1)).alias("r"))
    limit = revisit.agg(F.coalesce(2 * F.avg("r"), F.lit((SPAN[1] - SPAN[0]) / 2)).alias("t"))
    gaps = I.gaps(islands, ["cell"], "lo", "hi", *SPAN)
    long = gaps.join(F.broadcast(limit), F.col("gap_hi") - F.col("gap_lo") >= F.col("t"))
    return long.groupBy("cell").agg(F.count("*").alias("long_gaps"), F.max(F.col("gap_hi") - F.col("gap_lo")).alias("longest_us"))


@query(f"""WITH {VISITS_SQL}, f AS (SELECT channel, cell, min(start_us) AS t FROM v WHERE cell IS NOT NULL GROUP BY ALL), a AS (SELECT n_nationkey AS id, n_nationkey * 4 AS lo, n_nationkey * 4 + 2 AS hi FROM nation WHERE n_regionkey < 3)
SELECT a.id, f.channel, f.cell FROM a JOIN f ON f.cell BETWEEN a.lo AND a.hi WHERE f.t >= 1705000000000000 AND NOT EXISTS (SELECT 1 FROM v WHERE v.channel = f.channel AND v.cell = f.cell AND v.tier = 'error')""")
def band_watch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New activity in armed regions, but for what a known relation already explains."""
    v = visits(spark, sf_dir).where("cell is not null")
    new = v.groupBy("channel", "cell").agg(F.min("start_us").alias("t")).where("t >= 1705000000000000")
    armed = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") * 4).alias("lo"), (F.col("n_nationkey") * 4 + 2).alias("hi"))
    hits = I.range_join(armed, new.withColumn("c2", F.col("cell")), [], ("lo", "cell"), ("hi", "c2"), 4)
    return hits.join(v.where("tier = 'error'").select("channel", "cell"), ["channel", "cell"], "left_anti").select("id", "channel", "cell")


@query(f"WITH {VISITS_SQL} SELECT floor(cell / 5)::BIGINT AS x, ((start_us // 21600000000) - 78892)::BIGINT AS y, least(greatest(floor((max(level) / 10) / 50 * 255), 0), 255)::INT AS shade FROM v WHERE cell IS NOT NULL GROUP BY 1, 2")
def pane_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A viewer's grid: the maximum of each cell of five bins by six hours, as one byte of 0 to 50 dB."""
    v = visits(spark, sf_dir).where("cell is not null")
    g = v.groupBy(F.floor(F.col("cell") / 5).alias("x"), (F.floor(F.col("start_us") / 21_600_000_000) - 78892).alias("y")).agg(F.max("level").alias("m"))
    return g.select("x", "y", F.least(F.greatest(F.floor(F.col("m") / 10 / 50 * 255), F.lit(0)), F.lit(255)).cast("int").alias("shade"))


@query("""WITH RECURSIVE p AS (SELECT p_partkey AS r, p_size * 10.0 AS x, p_retailprice AS y FROM part), n AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 144),
c AS MATERIALIZED (SELECT a FROM n GROUP BY a HAVING count(*) >= 4), e AS MATERIALIZED (SELECT n.a, n.b FROM n WHERE a IN (SELECT a FROM c) AND b IN (SELECT a FROM c)),
r AS (SELECT a, a AS b FROM c UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a), k AS MATERIALIZED (SELECT a, min(b) AS cluster FROM r GROUP BY a),
o AS (SELECT n.a, min(k.cluster) AS near FROM n JOIN k ON n.b = k.a GROUP BY n.a)
SELECT p.r AS p_partkey, coalesce(k.cluster, o.near) AS cluster FROM p LEFT JOIN k ON p.r = k.a LEFT JOIN o ON p.r = o.a""")
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of parts by size and price: at least four within reach make a core."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10.0).alias("x"), F.col("p_retailprice").alias("y"))
    return C.density_clusters(p, "p_partkey", "x", "y", 12.0, 4)


_PRIOR = {"click": 0.02, "purchase": 8.0, "signup": 1.0, "view": 0.5}
_FUSE = f"""t AS (SELECT channel, tier, sum(level) AS w, avg((level >= 150)::INT) AS o FROM v GROUP BY ALL), s AS (SELECT channel, tier, w * w * w / sum(w * w * w) OVER (PARTITION BY channel) AS l, max(o) OVER (PARTITION BY channel) * 0.5 AS o FROM t),
k AS (SELECT channel, coalesce(max(l) FILTER (tier = 'error'), 0) AS own, max(o) AS o, bool_or(tier = 'error') AS asked, coalesce(list({{'label': tier, 'l': l, 'prior': CASE tier {" ".join(f"WHEN '{t}' THEN {p}::DOUBLE" for t, p in _PRIOR.items())} END}} ORDER BY tier) FILTER (tier <> 'error'), []) AS known FROM s GROUP BY channel),
b AS (SELECT *, least(greatest(own, o), 0.9) AS u, list_reverse_sort(list_transform(known, lambda x: x.l)) AS r FROM k WHERE len(known) > 0)"""
_LEADS = "list_position(list_transform(known, lambda x: x.l * pow(x.prior, {t})), list_max(list_transform(known, lambda x: x.l * pow(x.prior, {t}))))"


@query(f"""WITH RECURSIVE {VISITS_SQL}, {_FUSE}, d AS MATERIALIZED (SELECT *, {_LEADS.format(t=0)} AS best, {_LEADS.format(t=0)} <> {_LEADS.format(t=1)} AND r[1] > 0 AND (len(r) < 2 OR r[2] <= 0 OR r[1] / r[2] >= 10) AS temper FROM b),
h AS (SELECT channel, known, best, 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi FROM d WHERE temper UNION ALL
  SELECT channel, known, best, i + 1, CASE WHEN {_LEADS.format(t="((lo + hi) / 2)")} = best THEN (lo + hi) / 2 ELSE lo END, CASE WHEN {_LEADS.format(t="((lo + hi) / 2)")} = best THEN hi ELSE (lo + hi) / 2 END FROM h WHERE i < 40),
e AS (SELECT d.*, coalesce(h.lo, 1.0) AS tau FROM d LEFT JOIN h ON d.channel = h.channel AND h.i = 40),
x AS (SELECT channel, u, asked, tau, len(known) AS n, unnest(known) AS y FROM e), w AS (SELECT channel, u, asked, tau, n, y.label AS tier, y.l * pow(y.prior, tau) AS w FROM x),
p AS (SELECT channel, tier, tau, (1 - u) * CASE WHEN sum(w) OVER (PARTITION BY channel) > 0 THEN w / sum(w) OVER (PARTITION BY channel) ELSE 1.0 / n END AS p, 0.999 AS cap FROM w UNION ALL SELECT channel, 'error', tau, u, 0.9 FROM e WHERE asked),
q AS (SELECT channel, tier, tau, p / sum(p) OVER (PARTITION BY channel) AS p, cap FROM p), z AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY p DESC, tier = 'error' DESC, tier DESC) AS i FROM q),
m AS (SELECT *, max(greatest(p - cap, 0)) FILTER (i = 1) OVER (PARTITION BY channel) AS excess FROM z)
SELECT channel, tier, round(p + CASE i WHEN 1 THEN -excess WHEN 2 THEN excess ELSE 0 END, 6) AS posterior, round(tau, 6) AS exponent FROM m""")
def fused_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior of each channel's tiers with a prior, ``error`` being the unknown class and strong levels an open-set score."""
    t = visits(spark, sf_dir).groupBy("channel", "tier").agg(F.sum("level").alias("w"), F.avg((F.col("level") >= 150).cast("int")).alias("o"))
    by = Window.partitionBy("channel")  # a row a tier
    cube = F.col("w") * F.col("w") * F.col("w")
    prior = F.coalesce(*(F.when(F.col("tier") == k, float(x)) for k, x in _PRIOR.items()))
    s = t.select("channel", "tier", (cube / F.sum(cube).over(by)).alias("l"), (F.max("o").over(by) * 0.5).alias("o"), prior.alias("prior"))
    known = s.join(s.where("tier <> 'error'").select("channel").distinct(), "channel", "left_semi")
    return C.fused(known, "channel", "tier", "l", "prior", "o", "error").select("channel", "tier", F.round("posterior", 6).alias("posterior"), F.round("exponent", 6).alias("exponent"))


@query("""WITH e AS (SELECT vec_id, embedding AS z FROM embeddings), p AS (SELECT vec_id, list_transform(z, lambda x: exp((x::DOUBLE - list_max(z)::DOUBLE) / 0.5)) AS p FROM e)
SELECT vec_id, round(list_max(p) / list_sum(p), 6) AS best, round(-0.5 * ln(list_sum(p)), 6) AS energy FROM p""")
def softmax_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best probability at a temperature, and the free energy over the largest logit, of each vector's values."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))
    top = F.array_max("z")
    powers = F.aggregate(F.transform("z", lambda x: F.exp((x - top) / 0.5)), F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(F.array_max(C.softmax(F.col("z"), 0.5)), 6).alias("best"), F.round(-0.5 * F.ln(powers), 6).alias("energy"))


@query("""WITH b AS (SELECT page_id, hex(encode(url)) AS h FROM pages WHERE url IS NOT NULL), u AS (SELECT page_id, substr(h, 2 * i::INT + 1, 8) AS word FROM (SELECT page_id, h, unnest(range(length(h) // 2 - 3)) AS i FROM b)),
e AS (SELECT page_id, word, count(*) AS n FROM u GROUP BY ALL) SELECT word, count(*)::BIGINT AS frames, sum(n)::BIGINT AS places FROM e GROUP BY word HAVING count(*) >= 10""")
def sync_word_hunt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32-bit words that ten or more frames hold: sync candidates."""
    p = table(spark, sf_dir, "pages").where("url is not null").withColumn("raw", F.col("url").cast("binary"))
    return B.word_hunt(p, "page_id", "raw", 4).where("frames >= 10")


@query("""WITH b AS (SELECT hex(encode(url)) AS h FROM pages WHERE length(url) > 0), u AS (SELECT i, substr(h, 2 * i::INT + 1, 2) AS x FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM b)),
c AS (SELECT i, x, count(*) AS n FROM u GROUP BY ALL) SELECT i::INT AS at, sum(n)::BIGINT AS n, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c GROUP BY i""")
def field_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy of each byte place of the frames."""
    p = table(spark, sf_dir, "pages").where("length(url) > 0").withColumn("raw", F.col("url").cast("binary"))
    return B.place_entropy(p, "raw").select("at", "n", F.round("entropy", 6).alias("entropy"))


_MODELS = " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*)::BIGINT AS frames, (count(*) FILTER ({B.crc_sql(m, f'v[1:len(v) - {w[0] // 8}]')} = list_reduce(list_prepend(0::BIGINT, v[len(v) - {w[0] // 8 - 1}:]), lambda a, x: a * 256 + x)))::BIGINT AS valid FROM f WHERE len(v) > {w[0] // 8}"
    for m, w in sorted(B.CRC_MODELS.items())
)


@query(f"""WITH o AS (SELECT list_transform(regexp_extract_all(hex(encode(url)), '..'), lambda x: ('0x' || x)::BIGINT) AS o FROM pages WHERE url IS NOT NULL),
k AS (SELECT o, {B.crc_sql('crc16-x25', 'o')} AS k FROM o), f AS (SELECT list_concat(o, [k >> 8, k & 255]) AS v FROM k) SELECT * FROM ({_MODELS}) WHERE frames > 0""")
def crc_model_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which check the frames end in: urls with a CRC-16 put behind them, against all models."""
    p = table(spark, sf_dir, "pages").where("url is not null").withColumn("raw", F.col("url").cast("binary"))
    tail = F.unhex(F.lpad(F.hex(B.crc("crc16-x25")("raw")), 4, "0"))
    return B.crc_search(p.select(F.concat("raw", tail).alias("raw")), "raw")


@query("""SELECT l.l_orderkey, l.l_linenumber, o.o_orderstatus, c.c_mktsegment, s.s_name FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P' LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_acctbal > 0 LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0""")
def provenance_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with what is known of their order, its customer and their supplier; unknown parts are null."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    o = t("orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_orderstatus", "o_custkey")
    c = t("customer").where("c_acctbal > 0").select("c_custkey", "c_mktsegment")
    s = t("supplier").where("s_acctbal > 0").select("s_suppkey", "s_name")
    joined = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("l_orderkey", "l_linenumber", "o_orderstatus", "c_mktsegment", "s_name")


_GATE = {"open": 0, "metadata": 1, "refused": 2}


@query("""WITH g AS (SELECT o_orderkey, greatest(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END) AS g FROM orders)
SELECT g.o_orderkey, CASE g WHEN 0 THEN 'open' WHEN 1 THEN 'metadata' ELSE 'refused' END AS gate, CASE WHEN g = 0 THEN o_totalprice WHEN g = 1 THEN round(o_totalprice, -3) END AS value FROM g JOIN orders USING (o_orderkey)""")
def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strictest content class that applies, and what of the value it lets through."""
    by_class = F.when(F.col("o_orderstatus") == "F", _GATE["open"]).when(F.col("o_orderstatus") == "O", _GATE["metadata"]).otherwise(_GATE["refused"])
    g = F.greatest(by_class, F.when(F.col("o_totalprice") > 250000, _GATE["metadata"]).otherwise(_GATE["open"]))
    name = F.when(g == 0, "open").when(g == 1, "metadata").otherwise("refused")
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("gate"), F.when(g == 0, F.col("o_totalprice")).when(g == 1, F.round("o_totalprice", -3)).alias("value"))


@query("""SELECT d.doc_id, d.source, d.lang, l.quality, l.toxic, sha256(coalesce(d.text, '')) AS digest FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL""")
def labelled_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labelled set's manifest: labels with the digest of each snippet."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where("quality is not null")
    return d.select("doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).join(labels, "doc_id").select("doc_id", "source", "lang", "quality", "toxic", "digest")


@query(f"""WITH {VISITS_SQL}, w AS (SELECT event_id, count(*) OVER (PARTITION BY channel ORDER BY start_us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS n FROM v WHERE level >= 60) SELECT event_id, n::BIGINT AS n FROM w WHERE n >= 5""")
def confirmed_in_a_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that five or more of their channel confirm within the week before."""
    by = Window.partitionBy("channel").orderBy("start_us").rangeBetween(-604_800_000_000, 0)
    return visits(spark, sf_dir).where("level >= 60").withColumn("n", F.count("*").over(by)).where("n >= 5").select("event_id", "n")


@query(f"""WITH {VISITS_SQL}, c AS (SELECT channel, tier, start_us, lag(end_us) OVER (PARTITION BY channel ORDER BY start_us, event_id) AS pe, lead(start_us) OVER (PARTITION BY channel ORDER BY start_us, event_id) AS ns, end_us, event_id FROM v WHERE tier IN ('view', 'click'))
SELECT channel, count(*)::BIGINT AS calls, sum((ns IS NOT NULL AND ns < end_us)::INT)::BIGINT AS truncated FROM c GROUP BY channel""")
def truncated_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of each system and how many the next one cut short."""
    by = Window.partitionBy("channel").orderBy("start_us", "event_id")
    c = visits(spark, sf_dir).where(F.col("tier").isin("view", "click")).withColumn("cut", F.coalesce(F.lead("start_us").over(by) < F.col("end_us"), F.lit(False)))
    return c.groupBy("channel").agg(F.count("*").alias("calls"), F.count_if("cut").alias("truncated"))


@query("""WITH o AS (SELECT o_custkey AS k, epoch_us(o_orderdate) AS t, o_orderkey AS id, o_totalprice AS x FROM orders), p AS (SELECT *, lag(x) OVER (PARTITION BY k ORDER BY t, id) AS px FROM o)
SELECT id AS o_orderkey, round(x - px, 4) AS step FROM p WHERE px IS NOT NULL AND abs(x - px) > 150000""")
def provenance_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps of a source's value against its row before."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", micros("o_orderdate").alias("t"))
    step = F.col("o_totalprice") - F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("t", "o_orderkey"))
    return o.withColumn("step", step).where(F.abs("step") > 150000).select("o_orderkey", F.round("step", 4).alias("step"))


@query("""WITH l AS (SELECT l_orderkey % 97 AS g, l_linenumber AS n, l_returnflag AS f, l_linestatus AS s FROM lineitem) SELECT coalesce(f, 'all') AS f, coalesce(s, 'all') AS s, count(*)::BIGINT AS n, count(DISTINCT g)::BIGINT AS groups FROM l GROUP BY ROLLUP (f, s)""")
def level_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over the lattice of levels."""
    line = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 97).alias("g"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("s"))
    return line.rollup("f", "s").agg(F.count("*").alias("n"), F.countDistinct("g").alias("groups")).select(F.coalesce("f", F.lit("all")).alias("f"), F.coalesce("s", F.lit("all")).alias("s"), "n", "groups")


@query("""WITH a AS (SELECT s_suppkey AS a, s_nationkey AS k, floor(s_acctbal / 100) AS q FROM supplier), b AS (SELECT c_custkey AS b, c_nationkey AS k, floor(c_acctbal / 100) AS q FROM customer)
SELECT a, b FROM a JOIN b USING (k, q) EXCEPT SELECT a, b FROM a JOIN b USING (k) WHERE b % 2 = 0""")
def relation_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct related ids without those of another rule."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("k"), F.floor(F.col("s_acctbal") / 100).alias("q"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("b"), F.col("c_nationkey").alias("k"), F.floor(F.col("c_acctbal") / 100).alias("q"))
    return R.distinct_pairs(a, b.where("b % 2 <> 0"), "a", "b", ["k", "q"])


@query(f"""WITH {VISITS_SQL}, a AS (SELECT event_id, cell * 10 + level AS f FROM v WHERE tier = 'purchase' AND cell IS NOT NULL), k AS (SELECT event_id, f, unnest(range(-3, 4)) AS k FROM a)
SELECT event_id, arg_min(k, (round(abs((f + 37.5 * k) - round((f + 37.5 * k) / 12.5) * 12.5) + 0.5 * abs(k), 9), k))::INT AS k FROM k GROUP BY event_id""")
def alias_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the images of a frequency the one that lies best on a raster, less far ones first."""
    a = visits(spark, sf_dir).where("tier = 'purchase' and cell is not null").select("event_id", (F.col("cell") * 10 + F.col("level")).alias("f"), F.explode(F.sequence(F.lit(-3), F.lit(3))).alias("k"))
    at = F.col("f") + 37.5 * F.col("k")
    cost = F.round(F.abs(at - F.round(at / 12.5) * 12.5) + 0.5 * F.abs("k"), 9)
    return a.groupBy("event_id").agg(F.min_by("k", F.struct(cost, "k")).alias("k"))

