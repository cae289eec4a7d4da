"""Queries of evidence rules and traced paths over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.operators import evidence as E
from spectraloom.operators import paths as P
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, table, visits

DAY = 86_400_000_000
#: The path rule on series of days.
DAYS = E.PATH_RULE | {"peak": 0.2, "dominance": 1.1, "delay": 1.0, "resolutions": 0.5, "support": 2, "attenuation": 3.0}

_LAGS = f"""s AS (SELECT channel AS k, start_us // {DAY} AS at, sum(level) AS x FROM v GROUP BY ALL), g AS (SELECT unnest(range(-2, 3)) AS lag),
j AS (SELECT a.k AS a, b.k AS b, lag, a.at, a.x AS x, b.x AS y FROM s a CROSS JOIN g JOIN s b ON b.k = a.k + 1 AND b.at = a.at + lag),
c AS (SELECT a, b, lag, count(*)::BIGINT AS n, round(corr(x, y), 9) AS r FROM j GROUP BY ALL HAVING max(x) > min(x) AND max(y) > min(y)),
best AS (SELECT a, b, lag, n, r AS peak FROM c QUALIFY row_number() OVER (PARTITION BY a, b ORDER BY r DESC, abs(lag), lag) = 1),
d AS (SELECT best.*, (SELECT max(r) FROM c WHERE c.a = best.a AND c.b = best.b AND abs(c.lag - best.lag) > 1) AS rival FROM best)"""


def _series(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    s = v.groupBy(F.col("channel").alias("k"), F.floor(F.col("start_us") / DAY).alias("at")).agg(F.sum("level").alias("x"))
    return s, s.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b")).distinct()


@query(f"WITH {VISITS_SQL}, {_LAGS} SELECT a, b, lag, n, r FROM c")
def content_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each channel's daily levels with its neighbour's, up to two days apart."""
    s, pairs = _series(visits(spark, sf_dir))
    return E.lag_correlations(s, pairs, "k", "at", "x", 2).select("a", "b", F.col("lag").cast("long").alias("lag"), "n", F.round("r", 9).alias("r"))


@query(f"""WITH {VISITS_SQL}, {_LAGS}, q AS (SELECT j.a, j.b, j.at // 6 AS part, corr(x, y) AS r FROM j JOIN d ON j.a = d.a AND j.b = d.b AND j.lag = d.lag GROUP BY ALL HAVING max(x) > min(x) AND max(y) > min(y)),
u AS (SELECT a, b, count(*)::BIGINT AS segments, count(*) FILTER (round(r, 9) >= 0.5)::BIGINT AS support FROM q GROUP BY ALL), m AS (SELECT channel, round(10 * log10(avg(level)), 9) AS db FROM v GROUP BY 1),
w AS (SELECT d.*, CASE WHEN rival > 0 THEN peak / rival ELSE 'Infinity'::DOUBLE END AS dom, coalesce(segments, 0) AS segments, coalesce(support, 0) AS support, CASE WHEN d.a % 3 = 0 THEN d.a % 2 END AS ia, CASE WHEN d.b % 3 = 0 THEN d.b % 2 END AS ib,
  CASE WHEN lag > 0 THEN ma.db - mb.db ELSE mb.db - ma.db END AS lost FROM d LEFT JOIN u ON d.a = u.a AND d.b = u.b JOIN m ma ON ma.channel = d.a JOIN m mb ON mb.channel = d.b)
SELECT a, b, lag, segments, support, CASE WHEN ia <> ib THEN 'independent' WHEN n < 2 THEN 'undecidable' WHEN peak < 0.2 THEN 'independent' WHEN dom < 1.1 THEN 'undecidable' WHEN segments = 0 THEN 'undecidable'
  WHEN support < 2 OR support < 0.5 * segments THEN 'undecidable' WHEN abs(lag) <= 0.5 THEN 'undecidable' WHEN abs(lag) > 1 THEN 'independent' WHEN lost < -1 OR lost > 3 THEN 'undecidable' ELSE 'related' END AS verdict FROM w""")
def multipath_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neighbouring channels carry one content over two paths."""
    v = visits(spark, sf_dir)
    s, pairs = _series(v)
    delays = E.best_delay(E.lag_correlations(s, pairs, "k", "at", "x", 2).withColumn("r", F.round("r", 9)))
    level = v.groupBy("channel").agg(F.round(10 * F.log10(F.avg("level")), 9).alias("db"))
    both = delays.join(E.path_support(s, delays, "k", "at", "x", 6), ["a", "b"], "left")
    for side in ("a", "b"):
        both = both.join(level.select(F.col("channel").alias(side), F.col("db").alias(f"db_{side}")), side)
    name = lambda c: F.when(F.col(c) % 3 == 0, F.col(c) % 2)
    verdict = E.path_verdict(name("a"), name("b"), F.col("n"), F.lit(1.0), F.col("peak"), F.col("dominance"), F.col("support"), F.col("segments"), F.lit(None).cast("double"), F.col("lag").cast("double"), F.col("db_a"), F.col("db_b"), DAYS)
    return both.select("a", "b", F.col("lag").cast("long").alias("lag"), F.coalesce("segments", F.lit(0)).alias("segments"), F.coalesce("support", F.lit(0)).alias("support"), verdict.alias("verdict"))


RECIPES = [
    ("blank", None, None, None, None, None, None),
    ("narrow", ["economy", "promo"], (900.0, 905.0), (10.0, 20.0), True, ["cold"], (0.0, 50.0)),
    ("open", None, (850.0, 1500.0), (30.0, 30.0), None, ["Small", "large"], None),
    ("wide", ["large/a", "medium"], (905.0, 1200.0), None, False, [], None),
]


def _away(x: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {x} BETWEEN {lo} AND {hi} THEN 0.0::DOUBLE ELSE abs({x} - CASE WHEN {x} < {lo} THEN {lo} ELSE {hi} END) / greatest(({hi} - {lo}) / 2, 0.25 * CASE WHEN {x} < {lo} THEN {lo} ELSE {hi} END) END"


@query(f"""WITH r(id, fam, blo, bhi, rlo, rhi, bur, feat, clo, chi) AS (VALUES ('blank', NULL::VARCHAR[], NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, NULL::BOOLEAN, NULL::VARCHAR[], NULL::DOUBLE, NULL::DOUBLE),
  ('narrow', ['economy', 'promo'], 900, 905, 10, 20, true, ['cold'], 0, 50), ('open', NULL, 850, 1500, 30, 30, NULL, ['small', 'large'], NULL, NULL), ('wide', ['large/a', 'medium'], 905, 1200, NULL, NULL, false, NULL, NULL, NULL)),
m AS (SELECT p_partkey AS part, lower(p_type) AS family, p_retailprice AS bw, CASE WHEN p_size > 3 THEN p_size::DOUBLE END AS rate, CASE WHEN p_size % 5 > 0 THEN p_size % 2 = 0 END AS burst, split_part(p_name, ' ', 1) AS feature FROM part),
x AS (SELECT * FROM m CROSS JOIN r),
f AS (SELECT part, id, 3.0 AS w, CASE WHEN list_contains(fam, family) THEN 0.0::DOUBLE END AS z FROM x WHERE fam IS NOT NULL UNION ALL SELECT part, id, 1.5, CASE WHEN bw IS NOT NULL THEN {_away('bw', 'blo', 'bhi')} END FROM x WHERE blo IS NOT NULL
  UNION ALL SELECT part, id, 2.0, CASE WHEN rate IS NOT NULL THEN {_away('rate', 'rlo', 'rhi')} END FROM x WHERE rlo IS NOT NULL UNION ALL SELECT part, id, 1.0, CASE WHEN burst = bur THEN 0.0 WHEN burst <> bur THEN 4.0 END FROM x WHERE bur IS NOT NULL
  UNION ALL SELECT part, id, 1.0, CASE WHEN want = feature THEN 0.0 END FROM (SELECT part, id, feature, unnest(feat) AS want FROM x)),
g AS (SELECT part, id, round(sum(w * coalesce(exp(-z * z / 2), 0)) / sum(w), 9)::DOUBLE AS score, count(z)::BIGINT AS compared, (count(*) FILTER (z <= 1))::BIGINT AS agreed, (count(*) FILTER (z > 3))::BIGINT AS conflicting, (count(*) FILTER (z IS NULL))::BIGINT AS unmeasured FROM f GROUP BY ALL),
h AS (SELECT x.part, x.id AS recipe, coalesce(score, 0) AS score, coalesce(compared, 0) AS compared, coalesce(agreed, 0) AS agreed, coalesce(conflicting, 0) AS conflicting, coalesce(unmeasured, 0) AS unmeasured, coalesce(x.part BETWEEN clo AND chi, false) AS hint,
  CASE WHEN g.id IS NULL THEN 'no expectations' WHEN fam IS NOT NULL AND NOT (list_contains(fam, family) OR len(list_filter(fam, lambda y: starts_with(y, family || '/'))) > 0) THEN 'other family' WHEN compared < 2 THEN 'too few compared' WHEN score < 0.2 THEN 'low score' END AS reason
  FROM x LEFT JOIN g ON x.part = g.part AND x.id = g.id)
SELECT part, recipe, score, CASE WHEN reason IS NOT NULL THEN 'none' WHEN score >= 0.8 AND conflicting = 0 THEN 'fit' ELSE 'partial' END AS outcome, compared, agreed, conflicting, unmeasured, reason,
  CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY part ORDER BY reason IS NULL DESC, score DESC, hint DESC, agreed DESC, unmeasured, recipe) END AS rank FROM h""")
def recipe_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recipes ranked for each part as a measured signal, with why others are ruled out."""
    size = F.col("p_size")
    m = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("part"),
        F.lower("p_type").alias("family"),
        F.col("p_retailprice").alias("bandwidth"),
        F.when(size > 3, size.cast("double")).alias("rate"),
        F.when(size % 5 > 0, size % 2 == 0).alias("bursty"),
        F.array(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("features"),
        F.col("p_partkey").alias("centre"),
    )
    return E.rank_recipes(m, RECIPES, "part")


@query()
def independent_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Independent frames among the urls of each top domain; a rank over two-element arithmetic, so no SQL."""
    p = table(spark, sf_dir, "pages").select(F.coalesce(F.regexp_extract("url", r"://[^/?#]*?([A-Za-z]+)(?:[/?#]|$)", 1), F.lit("")).alias("domain"), F.col("url").cast("binary").alias("raw"))
    return E.check_tally(p, ["domain"], "raw")


_DAYS = f"""d AS (SELECT channel, start_us // {DAY} AS day, avg(level) / 10 AS db, count(DISTINCT cell)::BIGINT AS now FROM v GROUP BY ALL), b AS (SELECT channel, avg(level) / 10 AS base FROM v GROUP BY 1),
e AS (SELECT d.*, round(db - base, 9) AS rise, lag(now) OVER w AS before, round(lag(db) OVER w - db, 9) AS fell FROM d JOIN b USING (channel) WINDOW w AS (PARTITION BY channel ORDER BY day))"""


@query(f"""WITH {VISITS_SQL}, {_DAYS}, f AS (SELECT *, rise >= 6 AS r, coalesce(greatest(before - now, 0) / before >= 0.8, false) AS al, before IS NOT NULL AND (before > now OR coalesce(fell >= 6, false)) AS so FROM e)
SELECT channel, day, CASE WHEN r THEN 'jamming' WHEN so THEN 'blockage' ELSE 'quiet' END AS verdict, CASE WHEN r AND al THEN 0.95 WHEN r AND so THEN 0.75 WHEN r OR so THEN 0.6 ELSE 0.0 END::DOUBLE AS confidence FROM f""")
def interference_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interference, obstruction or quiet for every channel's day, from its level over the baseline and its cells of the day before."""
    v = visits(spark, sf_dir)
    d = v.groupBy("channel", F.floor(F.col("start_us") / DAY).alias("day")).agg((F.avg("level") / 10).alias("db"), F.countDistinct("cell").alias("now"))
    base = v.groupBy("channel").agg((F.avg("level") / 10).alias("base"))
    by = Window.partitionBy("channel").orderBy("day")
    e = d.join(base, "channel").withColumns({"before": F.lag("now").over(by), "fell": F.round(F.lag("db").over(by) - F.col("db"), 9)})
    return e.select("channel", "day", E.jamming(F.round(F.col("db") - F.col("base"), 9), F.col("before"), F.col("now"), F.col("fell")).alias("j")).select("channel", "day", "j.*")


@query(f"""WITH {VISITS_SQL}, e AS (SELECT channel, cell % 8 AS locked, level / 50 AS spread, start_us / 1e6 - lag(start_us / 1e6) OVER w AS dt, sqrt((level * 1e5 - lag(level * 1e5) OVER w) ** 2 + ((cell - lag(cell) OVER w) * 1e5) ** 2) AS m, abs(level - lag(level) OVER w) / 1e2 AS c
  FROM v WINDOW w AS (PARTITION BY channel ORDER BY start_us, event_id)),
k AS (SELECT channel, (count(*) FILTER (locked >= 4 AND spread < 1.5))::BIGINT AS equal_power, (count(*) FILTER (dt > 0 AND m / dt > 340))::BIGINT AS position_jumps, (count(*) FILTER (dt > 0 AND c / dt > 1e-5))::BIGINT AS clock_jumps FROM e GROUP BY 1)
SELECT *, [0.0, 0.5, 0.8, 0.95][(equal_power > 0)::INT + (position_jumps > 0)::INT + (clock_jumps > 0)::INT + 1]::DOUBLE AS confidence FROM k""")
def false_position_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signs of false positions over every channel's visits as epochs."""
    e = visits(spark, sf_dir).select("channel", "event_id", (F.col("start_us") / 1e6).alias("t"), (F.col("cell") % 8).alias("locked"), (F.col("level") / 50).alias("spread_db"), (F.col("level") * 1e5).alias("x"), (F.col("cell") * 1e5).alias("y"), (F.col("level") / 1e2).alias("clock"))
    return E.false_positions(e, "channel", "t", "event_id")


@query()
def traced_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ramps and hop sequences of each channel's visits over time and level; ordered claims, so no SQL."""
    d = visits(spark, sf_dir).select("channel", "event_id", (F.col("start_us") / 1e6).alias("start"), (F.col("end_us") / 1e6).alias("end"), F.col("level").alias("f"), F.lit(20.0).alias("w"))
    return P.traced_paths(d, "channel", "event_id", "start", "end", "f", "w", P.PathRule(least_gap=172_800.0, alike=4.0)).withColumn("members", F.array_join(F.col("members").cast("array<string>"), ","))
