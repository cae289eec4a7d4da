"""Queries of features, evidence, windows, rankings and labels over the observation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import labels as L
from spectraloom.functions.scalar import rounded
from spectraloom.operators import attention as A
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, table, visits

DAY = 86_400_000_000


@query(f"""WITH {VISITS_SQL}, o AS (SELECT channel, unnest([{{'name': 'level', 'value': level, 'sigma': 2.0, 'label': NULL}}, {{'name': 'tier', 'value': NULL, 'sigma': NULL, 'label': tier}}]) AS x, tier = 'error' AS suspect FROM v),
p AS (SELECT channel, x.name, x.value, coalesce(x.sigma, 0) AS sigma, x.label, suspect FROM o),
t AS (SELECT channel, name, label FROM (SELECT channel, name, label, count(*) AS n FROM p WHERE NOT suspect AND label IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY channel, name ORDER BY n DESC, label) = 1),
n AS (SELECT channel, name, count(*) FILTER (NOT suspect) AS n, count(*) FILTER (suspect) AS n_suspect, avg(value) FILTER (NOT suspect) AS value, sqrt(coalesce(var_samp(value) FILTER (NOT suspect), 0) + avg(sigma * sigma) FILTER (NOT suspect AND value IS NOT NULL)) AS spread,
  min(value) FILTER (NOT suspect) AS low, max(value) FILTER (NOT suspect) AS high FROM p GROUP BY ALL)
SELECT channel, name, n, n_suspect, round(value, 6) AS value, round(spread, 6) AS spread, low, high, label FROM n LEFT JOIN t USING (channel, name)""")
def emission_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level and tier of each channel as its emission's features; an ``error`` is suspect."""
    none = lambda kind: F.lit(None).cast(kind)
    one = lambda name, value, sigma, label: F.struct(F.lit(name).alias("name"), value.alias("value"), sigma.alias("sigma"), label.alias("label"))
    seen = F.explode(F.array(one("level", F.col("level"), F.lit(2.0), none("string")), one("tier", none("double"), none("double"), F.col("tier"))))
    rows = visits(spark, sf_dir).select("channel", (F.col("tier") == "error").alias("suspect"), seen.alias("x")).select("channel", "suspect", "x.*")
    found = A.emission_features(rows, ["channel"], "name", "value", "sigma", "label", "suspect")
    return found.select("channel", "name", "n", "n_suspect", F.round("value", 6).alias("value"), F.round("spread", 6).alias("spread"), "low", "high", "label")


@query(f"""WITH {VISITS_SQL}, e AS (SELECT channel, CASE WHEN tier <> 'view' THEN tier END AS grp, level / 100 AS bits FROM v),
g AS (SELECT channel, bits, 1 AS n, 1 AS g FROM e WHERE grp IS NULL UNION ALL SELECT channel, max(bits), count(*), 1 FROM e WHERE grp IS NOT NULL GROUP BY channel, grp)
SELECT channel, round(sum(bits), 6) AS bits, sum(n)::BIGINT AS n, sum(g)::BIGINT AS n_groups FROM g GROUP BY channel""")
def accumulated_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A channel's levels as bits of evidence: each view by itself, of the other tiers the strongest."""
    e = visits(spark, sf_dir).select("channel", F.when(F.col("tier") != "view", F.col("tier")).alias("grp"), (F.col("level") / 100).alias("bits"))
    return A.accumulated_evidence(e, ["channel"], "grp", "bits").withColumn("bits", F.round("bits", 6))


@query()
def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of each tier, scored by their mean level, packed into windows ten cells wide with half a cell around their centre left out."""
    scored = visits(spark, sf_dir).groupBy("tier", "cell").agg(F.round(F.avg("level"), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(F.desc("score"), "cell")).cast("long")
    items = scored.select("tier", rank.alias("rank"), (F.col("cell") - 0.5).cast("double").alias("lo"), (F.col("cell") + 0.5).cast("double").alias("hi"), "score")
    return A.packed_windows(items, ["tier"], 10.0, 0.25, 0.25)


@query()
def published_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest newest levels of a tier's channels, looked at once a day and given when they have changed by ten or more."""
    scores = visits(spark, sf_dir).select("tier", F.col("start_us").alias("t_us"), F.col("channel").alias("subject"), F.col("level").alias("score"))
    return A.published(scores, ["tier"], DAY, 5, 10.0)


_FAMILIES = "(VALUES " + ", ".join([f"('{n}', '{f}', '{b}')" for f, (b, classes) in L.TAXONOMY.items() for n in {f: 0, **dict.fromkeys(classes)}] + [f"('{n}', '{f}', '{L.TAXONOMY[f][0]}')" for n, f in L.OLDER.items()] + ["('unknown', 'unknown', 'unknown')"]) + ") f(name, family, branch)"
_NAMES = [" AM", "nbfm", "GFSK ", "8psk", "qam64", "ask", "fsk2", "unknown", "noise-like", "p25", "", "chirp"]


@query(f"""WITH {VISITS_SQL}, l AS (SELECT event_id, [{", ".join(f"'{n}'" for n in _NAMES)}][cell % {len(_NAMES)} + 1] AS label FROM v)
SELECT event_id, family, branch FROM l LEFT JOIN {_FAMILIES} ON lower(trim(label)) = f.name""")
def modulation_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family and branch of a label that each visit's cell stands for."""
    label = F.get(F.array(*map(F.lit, _NAMES)), (F.col("cell") % len(_NAMES)).cast("int"))
    return visits(spark, sf_dir).select("event_id", L.family_of(label).alias("family"), L.branch_of(label).alias("branch"))


@query("""WITH h AS (SELECT event_id, list_transform(regexp_extract_all(md5(event_id::VARCHAR), '..'), lambda x: ('0x' || x)::INT) AS c FROM events)
SELECT event_id, array_to_string(list_transform(c, lambda x: CASE WHEN x BETWEEN 32 AND 126 OR x >= 160 THEN chr(x) ELSE '\\x' || lower(format('{:02x}', x)) END), '') AS latin1,
  array_to_string(list_transform(c, lambda x: '0123456789*U -)('[(x & 15) + 1]), '') AS pager FROM h""".replace("\\\\", "\\"))
def decoded_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of a digest of each event's id as characters of two sets."""
    codes = F.unhex(F.md5(F.col("event_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", L.characters(codes, "latin1").alias("latin1"), L.characters(codes, "pager").alias("pager"))


@query(f"""WITH {VISITS_SQL}, p AS (SELECT *, lag(level) OVER w AS l0, lag(tier) OVER w AS t0, lag(cell) OVER w AS c0, lag(event_id) OVER w AS e0 FROM v WINDOW w AS (PARTITION BY channel ORDER BY start_us, event_id))
SELECT event_id, CASE WHEN e0 IS NULL THEN NULL WHEN tier <> t0 THEN 'different tier' WHEN cell // 10 <> c0 // 10 THEN 'different band' END AS reason, round((level / l0 - 1) * 1e6, 3) AS ppm,
  round(10 * log10(2.0 / (12 * 128 * 128)) - 10 * log10(1000 + cell) + 10 * log10(1.5 * (1000 + cell) / 256), 6) AS noise_dbfs FROM p""")
def level_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a visit's level can't be compared with the channel's last one, what it differs by, and the noise of eight bits at a rate of its cell."""
    by = Window.partitionBy("channel").orderBy("start_us", "event_id")
    key = F.struct("tier", F.expr("cell div 10").alias("band"))
    v = visits(spark, sf_dir).withColumn("key", key).withColumns({"key0": F.lag("key").over(by), "l0": F.lag("level").over(by)})
    known = lambda a, b: F.struct(*(F.coalesce(F.col(f"{a}.{f}"), F.col(f"{b}.{f}")).alias(f) for f in ("tier", "band")))  # noqa: E731  # what isn't known differs from nothing
    because = F.when(F.col("key0").isNotNull(), L.incomparable_because(known("key", "key0"), known("key0", "key"), {"tier": "different tier", "band": "different band"}))
    level, l0 = F.col("level"), F.col("l0")
    beyond = F.when(l0 == 0, level * F.pow(l0, F.lit(-1.0))).otherwise((level / l0 - 1) * 1e6)  # a last level of 0 is infinitely far away, to the side of its sign
    ppm = F.coalesce(L.ppm_from_line(level, F.lit(1.0), l0)["ppm"], beyond)
    noise = L.quantisation_noise(1000.0 + F.col("cell"), F.lit(256), 1.5)["dbfs_per_bin"]
    return v.select("event_id", because.alias("reason"), rounded(ppm, 3).alias("ppm"), rounded(noise, 6).alias("noise_dbfs"))


@query(f"""WITH {VISITS_SQL}, r AS (SELECT event_id, channel, start_us, row_number() OVER (ORDER BY start_us, event_id) AS i FROM v WHERE tier = 'view' AND cell BETWEEN 10 AND 60)
SELECT event_id, channel, start_us::BIGINT AS start_us FROM r WHERE i > 25 AND i <= 50""")
def records_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 25 records, asked for by the last record of the first. The page is the feature."""
    rows = visits(spark, sf_dir).where("tier = 'view' and cell between 10 and 60").select("event_id", "channel", "start_us")
    first = A.page_after(rows, ["start_us", "event_id"], None, 25)
    return A.page_after(rows, ["start_us", "event_id"], A.last_key(first, ["start_us", "event_id"]), 25)
