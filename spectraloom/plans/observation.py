"""Queries over the observation log: coverage, visits, occupancy, baselines, floors and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import scalar as S
from spectraloom.operators import aggregates as A
from spectraloom.operators import intervals as I
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, visits

TIERS = ["click", "view", "purchase", "signup", "error"]
#: The span asked for: 2024-01-05 to 2024-01-25, in microseconds. Fixed values.
SPAN = (1704412800000000, 1706140800000000)
DAY = 86_400_000_000
QUARTER = 900_000_000
#: Islands of a channel's visits in SQL: touching ones join.
ISLANDS = """m AS (SELECT *, max(end_us) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM {src}),
  g AS (SELECT *, sum(CASE WHEN pe IS NULL OR start_us > pe THEN 1 ELSE 0 END) OVER (PARTITION BY channel ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS g FROM m),
  isl AS (SELECT channel, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS n, bool_or(tier IN ('view', 'error')) AS independent FROM g GROUP BY channel, g)"""
IN_SPAN = f"s AS (SELECT * FROM v WHERE end_us > {SPAN[0]} AND start_us < {SPAN[1]})"
GAPS = f"""gp AS (SELECT channel, coalesce(lag(end_us) OVER (PARTITION BY channel ORDER BY start_us), {SPAN[0]}) AS gap_lo, start_us AS gap_hi FROM isl
  UNION ALL SELECT channel, max(end_us), {SPAN[1]} FROM isl GROUP BY channel)"""


def _inside(v: DataFrame) -> DataFrame:
    return v.where((F.col("end_us") > SPAN[0]) & (F.col("start_us") < SPAN[1]))


@query(f"WITH {VISITS_SQL}, {ISLANDS.format(src='v')} SELECT channel, start_us::BIGINT AS start_us, end_us::BIGINT AS end_us, n::BIGINT AS n, independent FROM isl")
def visits_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged visits of every channel; independent of activity if any part is."""
    v = visits(spark, sf_dir).withColumn("independent", F.col("tier").isin("view", "error"))
    return I.merge(v, ["channel"], "start_us", "end_us", DAY, flags=["independent"])


#: Every channel; one that isn't visited in the span is a gap as long as the span.
EVERY = f"""e AS (SELECT DISTINCT channel FROM v), ga AS (SELECT * FROM gp UNION ALL SELECT channel, {SPAN[0]}, {SPAN[1]} FROM e WHERE channel NOT IN (SELECT channel FROM isl))"""


@query(f"""WITH {VISITS_SQL}, {IN_SPAN}, {ISLANDS.format(src='s')}, {GAPS}, {EVERY}
SELECT channel, gap_lo::BIGINT AS gap_lo, gap_hi::BIGINT AS gap_hi FROM ga WHERE gap_hi - gap_lo >= 3600000000""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours and longer without a visit in the span, its edges counted."""
    v = visits(spark, sf_dir)
    islands = I.merge(_inside(v), ["channel"], "start_us", "end_us", DAY)
    return I.gaps(islands, ["channel"], "start_us", "end_us", *SPAN, least=3_600_000_000, asked=v)


_TIER_SQL = ", ".join(f"sum(CASE WHEN tier = '{t}' THEN least(end_us, {SPAN[1]}) - greatest(start_us, {SPAN[0]}) ELSE 0 END)::BIGINT AS {t}_us" for t in TIERS)


@query(f"""WITH {VISITS_SQL}, {IN_SPAN}, {ISLANDS.format(src='s')}, {GAPS}, {EVERY},
t AS (SELECT channel, {_TIER_SQL} FROM s GROUP BY channel),
c AS (SELECT channel, count(*)::BIGINT AS n_visits, (count(*) FILTER (independent))::BIGINT AS n_independent, CASE WHEN count(*) > 1 THEN least((max(start_us) - min(start_us)) / (count(*) - 1), {float(SPAN[1] - SPAN[0])}) END::DOUBLE AS mean_revisit_us FROM isl GROUP BY channel),
l AS (SELECT channel, max(gap_hi - gap_lo)::BIGINT AS longest_gap_us FROM ga WHERE gap_hi > gap_lo GROUP BY channel)
SELECT channel, coalesce(n_visits, 0) AS n_visits, coalesce(n_independent, 0) AS n_independent, mean_revisit_us, {", ".join(f"coalesce({t}_us, 0) AS {t}_us" for t in TIERS)}, longest_gap_us
FROM e LEFT JOIN c USING (channel) LEFT JOIN t USING (channel) LEFT JOIN l USING (channel)""")
def obs_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: visits, revisits, longest gap and seconds of each tier, by channel."""
    return I.totals(visits(spark, sf_dir), ["channel"], "start_us", "end_us", "tier", TIERS, *SPAN, DAY, independent=["view", "error"])


@query(f"""WITH {VISITS_SQL}, w AS (SELECT channel, tier, greatest(start_us - 1800000000, {SPAN[0]}) AS start_us, least(end_us, {SPAN[1]}) AS end_us FROM v),
s AS (SELECT * FROM w WHERE start_us < end_us), {ISLANDS.format(src='s')}
SELECT channel, round(sum(end_us - start_us) / {float(SPAN[1] - SPAN[0])}, 9) AS poi FROM isl GROUP BY channel""")
def poi_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chance that an event of half an hour meets a visit, by channel."""
    return I.intercept_share(visits(spark, sf_dir), ["channel"], "start_us", "end_us", 1_800_000_000, *SPAN, DAY).select("channel", F.round("poi", 9).alias("poi"))


_COVER = """cov AS (SELECT c.cell, v.channel, v.start_us, v.end_us, v.tier FROM v JOIN (SELECT DISTINCT cell FROM v) c ON c.cell BETWEEN v.cell - 2 AND v.cell + 2
  AND NOT (c.cell = v.cell))"""


@query(f"WITH {VISITS_SQL}, {_COVER} SELECT cell, count(*)::BIGINT AS n_visits, count(DISTINCT channel)::BIGINT AS n_channels, sum(end_us - start_us)::BIGINT AS observed_us FROM cov GROUP BY cell")
def containment_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits that qualify for a cell: it lies within the visit's window of two cells each way, less its notch of one cell.

    The notch cuts the window in two, and a cell must lie in one of the pieces.
    """
    v = visits(spark, sf_dir).where("cell is not null")
    window = v.select("channel", "start_us", "end_us", (F.col("cell") - 2).alias("w_lo"), (F.col("cell") + 3).alias("w_hi"), F.col("cell").alias("n_lo"), (F.col("cell") + 1).alias("n_hi"))
    usable = I.subtract(window, "w_lo", "w_hi", "n_lo", "n_hi")
    cells = v.select(F.col("cell").alias("c_lo"), (F.col("cell") + 1).alias("c_hi"), "cell").distinct()
    pairs = I.range_join(cells, usable, [], ("c_lo", "w_lo"), ("c_hi", "w_hi"), 4, contains=True)
    return pairs.groupBy("cell").agg(F.count("*").alias("n_visits"), F.countDistinct("channel").alias("n_channels"), F.sum(F.col("end_us") - F.col("start_us")).alias("observed_us"))


_N = "(count(*) FILTER (tier <> 'error'))::DOUBLE"
_OCC_SQL = f"""q AS (SELECT channel, (start_us // {QUARTER}) * {QUARTER} AS t_us, count(*) AS n_revisits, count(*) FILTER (level >= 100) AS n_occupied, count(*) FILTER (tier = 'error') AS n_suspect,
  sum((end_us - start_us) / 1000000) AS observed_s, round(sum((level >= 100)::INT * ((end_us - start_us) / 1000000)) FILTER (tier <> 'error') / sum((end_us - start_us) / 1000000) FILTER (tier <> 'error'), 12) AS fco,
  avg((level >= 100)::INT) AS fco_all, sum((level >= 100 OR tier = 'error')::INT * ((end_us - start_us) / 1000000)) / sum((end_us - start_us) / 1000000) AS fco_upper,
  count(DISTINCT cell) FILTER (level >= 100) / nullif(count(DISTINCT cell), 0)::DOUBLE AS fbo, max(end_us - start_us) / 1e6 AS revisit_max_s, 100.0::DOUBLE AS threshold_db, bool_or(level < 1) AS clamped,
  CASE WHEN {_N} > 0 THEN greatest({_N} * (1 - exp(-(900.0::DOUBLE / {_N}) / 300)) / (1 + exp(-(900.0::DOUBLE / {_N}) / 300)), least({_N}, 1.0)) END AS n_eff
  FROM v GROUP BY ALL)"""


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy rows of a quarter of an hour; errors are the suspect visits."""
    v = visits(spark, sf_dir).withColumns({"t_us": F.floor(F.col("start_us") / QUARTER) * QUARTER, "s": (F.col("end_us") - F.col("start_us")) / 1e6, "o": (F.col("level") >= 100).cast("int"), "suspect": F.col("tier") == "error"})
    sure = lambda c: F.sum(F.when(~F.col("suspect"), c))
    n = F.count_if(~F.col("suspect")).cast("double")
    return v.groupBy("channel", "t_us").agg(
        F.count("*").alias("n_revisits"),
        F.sum("o").alias("n_occupied"),
        F.count_if("suspect").alias("n_suspect"),
        F.sum("s").alias("observed_s"),
        F.round(sure(F.col("o") * F.col("s")) / sure(F.col("s")), 12).alias("fco"),
        F.avg("o").alias("fco_all"),
        (F.sum(F.when((F.col("o") == 1) | F.col("suspect"), F.col("s")).otherwise(0.0)) / F.sum("s")).alias("fco_upper"),
        (F.countDistinct(F.when(F.col("o") == 1, F.col("cell"))) / F.nullif(F.countDistinct("cell"), F.lit(0))).alias("fbo"),
        F.max("s").alias("revisit_max_s"),
        F.lit(100.0).alias("threshold_db"),
        F.bool_or(F.col("level") < 1).alias("clamped"),
        F.when(n > 0, S.effective_samples(n, 900 / n, F.lit(300.0))).alias("n_eff"),
    )


@query(f"WITH {VISITS_SQL}, {_OCC_SQL} SELECT channel, t_us::BIGINT AS t_us, n_revisits::BIGINT AS n_revisits, n_occupied::BIGINT AS n_occupied, n_suspect::BIGINT AS n_suspect, fco, round(fco_all, 9) AS fco_all, round(n_eff, 9) AS n_eff FROM q")
def occupancy_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occupancy of every channel by quarter of an hour."""
    return _quarters(spark, sf_dir).select("channel", "t_us", "n_revisits", "n_occupied", "n_suspect", "fco", F.round("fco_all", 9).alias("fco_all"), F.round("n_eff", 9).alias("n_eff"))


_Z2 = S.Z[0.95] ** 2


@query(f"""WITH {VISITS_SQL}, {_OCC_SQL}, u AS (SELECT *, CASE WHEN fco IS NOT NULL THEN observed_s * (n_revisits - n_suspect) / n_revisits END AS w FROM q),
r AS (SELECT channel, ((t_us // {4 * QUARTER}) * {4 * QUARTER})::BIGINT AS h_us, sum(fco * w) / nullif(sum(w), 0) AS fco, sum(fco_all * n_revisits) / sum(n_revisits) AS fco_all, sum(fco_upper * observed_s) / sum(observed_s) AS fco_upper,
  sum(fbo * observed_s) / sum(CASE WHEN fbo IS NOT NULL THEN observed_s END) AS fbo, sum(n_revisits)::BIGINT AS n_revisits, sum(n_suspect)::BIGINT AS n_suspect, max(revisit_max_s) AS revisit_max_s, median(threshold_db) AS threshold_db, bool_or(clamped) AS clamped,
  coalesce(sum(CASE WHEN fco IS NOT NULL THEN n_eff END), 0) AS n_eff FROM u GROUP BY ALL),
k AS (SELECT *, (fco + {_Z2} / (2 * n_eff)) / (1 + {_Z2} / n_eff) AS mid, sqrt({_Z2}) / (1 + {_Z2} / n_eff) * sqrt(fco * (1 - fco) / n_eff + {_Z2} / (4 * n_eff * n_eff)) AS half FROM r)
SELECT channel, h_us, round(fco, 9) AS fco, round(fco_all, 9) AS fco_all, round(fco_upper, 9) AS fco_upper, round(fbo, 9) AS fbo, n_revisits, n_suspect, revisit_max_s, threshold_db, clamped, round(n_eff, 9) AS n_eff,
  CASE WHEN n_eff >= 1 THEN round(CASE WHEN fco <= 0 THEN 0 ELSE greatest(0, least(1, mid - half)) END, 6) END AS lo, CASE WHEN n_eff >= 1 THEN round(CASE WHEN fco >= 1 THEN 1 ELSE greatest(0, least(1, mid + half)) END, 6) END AS hi FROM k""")
def occupancy_rollup_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarters rolled up to hours: weighted shares with their interval, longest revisit, median threshold, flags by or."""
    hours = _quarters(spark, sf_dir).withColumn("h_us", F.floor(F.col("t_us") / (4 * QUARTER)) * (4 * QUARTER))
    shares = [F.round(c, 9).alias(c) for c in ("fco", "fco_all", "fco_upper", "fbo", "n_eff")]
    ends = [F.round(f"interval.{c}", 6).alias(c) for c in ("lo", "hi")]
    return A.roll_up(hours, ["channel", "h_us"]).select("channel", "h_us", *shares, "n_revisits", "n_suspect", "revisit_max_s", "threshold_db", "clamped", *ends)


_Z = S.Z[0.95]


@query(f"""WITH {VISITS_SQL}, c AS (SELECT channel, count(*)::DOUBLE AS n, avg((level >= 100)::INT) AS p FROM v GROUP BY channel),
w AS (SELECT *, (p + {_Z} * {_Z} / (2 * n)) / (1 + {_Z} * {_Z} / n) AS mid, {_Z} / (1 + {_Z} * {_Z} / n) * sqrt(p * (1 - p) / n + {_Z} * {_Z} / (4 * n * n)) AS half FROM c)
SELECT channel, round(p, 9) AS p, round(CASE WHEN p <= 0 THEN 0 ELSE greatest(0, least(1, mid - half)) END, 9) AS lo, round(CASE WHEN p >= 1 THEN 1 ELSE greatest(0, least(1, mid + half)) END, 9) AS hi FROM w""")
def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of occupied visits of each channel with its 95 % interval."""
    c = visits(spark, sf_dir).groupBy("channel").agg(F.count("*").cast("double").alias("n"), F.avg((F.col("level") >= 100).cast("int")).alias("p"))
    c = c.withColumn("ci", S.wilson(F.col("p"), F.col("n")))
    return c.select("channel", F.round("p", 9).alias("p"), F.round("ci.lo", 9).alias("lo"), F.round("ci.hi", 9).alias("hi"))


_HOW = "((start_us // 86400000000 + 3) % 7 * 24 + (start_us // 3600000000) % 24)"
_SLOT_SQL = f"""b AS (SELECT {_HOW}::BIGINT AS slot, count(*) AS n_visits, sum(level) AS sx, sum(level * level) AS sxx, max(level) AS max_db,
  sum((end_us - start_us) / 1e6) AS w, sum(((end_us - start_us) / 1e6) * (level >= 100)::INT) AS ow FROM v GROUP BY 1)"""


def _slots(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    v = visits(spark, sf_dir).withColumns({"slot": S.hour_of_week(F.col("start_us")).cast("long"), "s": (F.col("end_us") - F.col("start_us")) / 1e6})
    return A.slot_sums(v, ["slot", *more], "level", "s", F.col("level") >= 100, F.lit(1.0))


@query(f"WITH {VISITS_SQL}, {_SLOT_SQL} SELECT slot, n_visits::BIGINT AS n_visits, round(sx / n_visits, 6) AS mean_db, CASE WHEN n_visits > 1 THEN round(sqrt(greatest(0, (sxx - sx * sx / n_visits) / (n_visits - 1))), 6) END AS std_db, max_db, round(ow / w, 9) AS fco FROM b")
def baseline_slots_168(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baseline of each hour of the week: mean, sample deviation, maximum and occupied share."""
    m = A.slot_measures(_slots(spark, sf_dir))
    return m.select("slot", "n_visits", F.round("mean_db", 6).alias("mean_db"), F.round("std_db", 6).alias("std_db"), "max_db", F.round("fco", 9).alias("fco"))


@query(f"WITH {VISITS_SQL}, {_SLOT_SQL} SELECT ((slot % 24) // 6)::BIGINT AS part, sum(n_visits)::BIGINT AS n_visits, round(sum(sx) / sum(n_visits), 6) AS mean_db, max(max_db) AS max_db, round(sum(ow) / sum(w), 9) AS fco FROM b GROUP BY 1")
def slot_pooling_day_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of single channels merged, and pooled by quarter of the day."""
    merged = A.merge_slots(_slots(spark, sf_dir, "channel").drop("channel"), ["slot"])
    pooled = A.slot_measures(A.merge_slots(merged.withColumn("part", F.floor(F.pmod("slot", F.lit(24)) / 6)), ["part"]))
    return pooled.select("part", "n_visits", F.round("mean_db", 6).alias("mean_db"), "max_db", F.round("fco", 9).alias("fco"))


@query(f"""WITH {VISITS_SQL}, {_SLOT_SQL}, p AS (SELECT slot, w AS how, sum(w) OVER (PARTITION BY slot % 24) AS hod, sum(w) OVER (PARTITION BY (slot % 24) // 6) AS part, sum(w) OVER () AS whole FROM b)
SELECT slot, CASE WHEN how >= 86400 THEN 'hour_of_week' WHEN hod >= 86400 THEN 'hour_of_day' WHEN part >= 86400 THEN 'day_part' WHEN whole >= 86400 THEN 'all' ELSE 'immature' END AS pool FROM p""")
def baseline_maturity(spark: SparkSession, sf_dir: str, least_s: float = 86_400.0) -> DataFrame:
    """The narrowest pool of each slot with a day or more of observed time (slots are 168 rows at most)."""
    b = _slots(spark, sf_dir).select("slot", F.col("weight_s").alias("w"))
    hour = F.pmod("slot", F.lit(24))
    pooled = lambda k: F.sum("w").over(Window.partitionBy(k))
    enough = lambda c: c >= least_s
    pool = F.when(enough(F.col("w")), "hour_of_week").when(enough(pooled(hour)), "hour_of_day").when(enough(pooled(F.floor(hour / 6))), "day_part").when(enough(F.sum("w").over(Window.partitionBy(F.lit(1)))), "all").otherwise("immature")
    return b.select("slot", pool.alias("pool"))


@query(f"""WITH {VISITS_SQL}, r AS (SELECT channel, level, row_number() OVER (PARTITION BY channel ORDER BY level) AS i, count(*) OVER (PARTITION BY channel) AS n FROM v)
SELECT channel, round(10 * log10(greatest(avg(pow(10, level / 100)), 1e-30)), 6) AS floor_db, count(*)::BIGINT AS n_used FROM r WHERE i <= least(greatest(round(n * 0.8), 1), n) GROUP BY channel""")
def eighty_percent_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power mean of the lowest 80 % of a channel's levels (tenths of the driver's values, as decibels)."""
    v = visits(spark, sf_dir).select("channel", (F.col("level") / 10).alias("db"))
    return A.eighty_percent_floor(v, ["channel"], "db").select("channel", F.round("floor_db", 6).alias("floor_db"), "n_used")


@query(f"WITH {VISITS_SQL} SELECT tier, round(median(level), 6) AS median_db, round(quantile_cont(level, 0.1), 6) AS p10, round(quantile_cont(level, 0.9), 6) AS p90 FROM v GROUP BY tier")
def exact_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, lowest and highest tenth of a tier's levels, by the bins that hold their ranks."""
    q = A.exact_quantiles(visits(spark, sf_dir), ["tier"], "level", {"median_db": 0.5, "p10": 0.1, "p90": 0.9})
    return q.select("tier", *(F.round(c, 6).alias(c) for c in ("median_db", "p10", "p90")))


_HIST = "h AS (SELECT tier, least(greatest(floor(level / 10), 0), 29)::INT AS bin, count(*) AS n FROM v GROUP BY ALL)"


@query(f"""WITH {VISITS_SQL}, {_HIST}, c AS (SELECT *, sum(n) OVER (PARTITION BY tier ORDER BY bin) AS c, sum(n) OVER (PARTITION BY tier) AS t FROM h)
SELECT tier, round(10 * (bin + greatest(0, t * 0.75 - (c - n)) / n), 6) AS value FROM c WHERE c >= t * 0.75 QUALIFY bin = min(bin) OVER (PARTITION BY tier)""")
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper quartile from bins of 10."""
    h = A.histogram(visits(spark, sf_dir), ["tier"], "level", 0.0, 10.0, 30)
    return A.histogram_percentile(h, ["tier"], 75.0, 0.0, 10.0).select("tier", F.round("value", 6).alias("value"))


@query(f"WITH {VISITS_SQL}, {_HIST} SELECT tier, bin, n::BIGINT AS n FROM h")
def level_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.histogram(visits(spark, sf_dir), ["tier"], "level", 0.0, 10.0, 30)


@query(f"WITH {VISITS_SQL} SELECT tier, floor(log2(level) * 4)::INT AS bin, count(*)::BIGINT AS n FROM v WHERE level > 0 GROUP BY ALL")
def log_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.log_histogram(visits(spark, sf_dir), ["tier"], "level", 4)


_PYR = """p0 AS (SELECT *, coalesce(occupied_s / cover_s, 0) AS max_share FROM (SELECT cell AS f, start_us // 3600000000 AS t, count(*) AS n, max(level / 10) AS max_db, sum(pow(10, level / 100)) AS power,
  sum((end_us - start_us) / 1e6) AS cover_s, sum(CASE WHEN level >= 100 THEN (end_us - start_us) / 1e6 ELSE 0 END) AS occupied_s FROM v GROUP BY ALL))"""
_FOLD = """SELECT floor(f / 4)::BIGINT AS f, floor(t / {t})::BIGINT AS t, sum(n) AS n, max(max_db) AS max_db, sum(power) AS power, sum(cover_s) / 4 AS cover_s,
  coalesce(max(occupied_s / nullif(cover_s, 0)), 0) * sum(cover_s) / 4 AS occupied_s, max(max_share) AS max_share FROM {src} GROUP BY 1, 2"""
_PYR_OUT = "f, t::BIGINT AS t, n::BIGINT AS n, max_db, round(power, 3) AS power, round(cover_s, 6) AS cover_s, round(occupied_s, 6) AS occupied_s, round(max_share, 9) AS max_share"


def _pyramid(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = visits(spark, sf_dir).withColumns({"db": F.col("level") / 10, "s": (F.col("end_us") - F.col("start_us")) / 1e6})
    return A.pyramid_base(v, F.col("cell"), F.floor(F.col("start_us") / 3_600_000_000), "db", F.col("s"), F.col("level") >= 100)


def _shown(level: DataFrame) -> DataFrame:
    places = {"power": 3, "cover_s": 6, "occupied_s": 6, "max_share": 9}
    return level.select("f", "t", "n", "max_db", *(F.round(c, k).alias(c) for c, k in places.items()))


@query(f"WITH {VISITS_SQL}, {_PYR} SELECT {_PYR_OUT} FROM p0")
def pyramid_l0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells by hour: count, maximum, summed power, covered and occupied seconds."""
    return _shown(_pyramid(spark, sf_dir))


@query(f"WITH {VISITS_SQL}, {_PYR}, p1 AS ({_FOLD.format(t=6, src='p0')}), p2 AS ({_FOLD.format(t=4, src='p1')}) SELECT {_PYR_OUT} FROM p2")
def pyramid_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folds up: 16 cells by a day."""
    return _shown(A.pyramid_fold(A.pyramid_fold(_pyramid(spark, sf_dir), 4, 6), 4, 4))


@query(f"WITH {VISITS_SQL} SELECT cell, arg_max(level, (start_us, event_id)) AS level, max(start_us)::BIGINT AS seen_us FROM v GROUP BY cell")
def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest level of each cell, the larger event id among equals."""
    return visits(spark, sf_dir).groupBy("cell").agg(F.max_by("level", F.struct("start_us", "event_id")).alias("level"), F.max("start_us").alias("seen_us"))


@query(f"""WITH {VISITS_SQL}, c AS (SELECT tier, cell, count(*) AS n FROM v GROUP BY ALL)
SELECT tier, cell, n::BIGINT AS n FROM c QUALIFY row_number() OVER (PARTITION BY tier ORDER BY n DESC, cell) = 1""")
def dominant_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest cell of each tier."""
    return A.mode_of(visits(spark, sf_dir), ["tier"], "cell")


@query(f"""WITH {VISITS_SQL}, h AS (SELECT DISTINCT (start_us // 86400000000)::BIGINT AS d FROM v), k AS (SELECT DISTINCT tier FROM v),
a AS (SELECT tier, (start_us // 86400000000)::BIGINT AS d, avg(level) AS m FROM v GROUP BY ALL)
SELECT k.tier, g.d, round(a.m, 6) AS mean_db FROM k CROSS JOIN (SELECT unnest(range((SELECT min(d) FROM h), (SELECT max(d) FROM h) + 1)) AS d) g LEFT JOIN a ON a.tier = k.tier AND a.d = g.d""")
def level_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means over a dense grid of days: an unobserved day is null, not quiet. The grid is days by tiers."""
    v = visits(spark, sf_dir).withColumn("d", F.floor(F.col("start_us") / DAY))
    grid = v.groupBy("tier").agg(F.lit(1).alias("one")).join(v.agg(F.min("d").alias("a"), F.max("d").alias("b")), F.lit(True)).select("tier", F.explode(F.sequence("a", "b")).alias("d"))
    means = v.groupBy("tier", "d").agg(F.avg("level").alias("m"))
    return grid.join(means, ["tier", "d"], "left").select("tier", "d", F.round("m", 6).alias("mean_db"))


@query(f"""WITH {VISITS_SQL}, {IN_SPAN} SELECT event_id, channel, tier, level FROM s WHERE cell BETWEEN 10 AND 40 AND tier IN ('view', 'click') ORDER BY start_us DESC, event_id DESC LIMIT 100 OFFSET 50""")
def records_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of the records query: box and tier filter, newest first. The limit is the feature."""
    v = _inside(visits(spark, sf_dir)).where(F.col("cell").between(10, 40) & F.col("tier").isin("view", "click"))
    return v.orderBy(F.desc("start_us"), F.desc("event_id")).offset(50).limit(100).select("event_id", "channel", "tier", "level")


@query(f"""WITH {VISITS_SQL}, c AS (SELECT channel, avg((level >= 100)::INT) AS fco, sum(end_us - start_us)::BIGINT AS observed_us FROM v GROUP BY channel)
SELECT channel, round(fco, 9) AS fco, observed_us FROM c ORDER BY c.fco DESC NULLS LAST, observed_us DESC, channel LIMIT 20""")
def top_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The busiest channels: a top-k report."""
    c = visits(spark, sf_dir).groupBy("channel").agg(F.avg((F.col("level") >= 100).cast("int")).alias("f"), F.sum(F.col("end_us") - F.col("start_us")).alias("observed_us"))
    return c.orderBy(F.desc_nulls_last("f"), F.desc("observed_us"), "channel").limit(20).select("channel", F.round("f", 9).alias("fco"), "observed_us")
