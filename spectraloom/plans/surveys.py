"""Queries of regions, provenance, evidence, families, clusters and pages over the driver's tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions import nulls as N
from spectraloom.operators import codes as K
from spectraloom.operators import intervals as I
from spectraloom.operators import regions as R
from spectraloom.plans.registry import query
from spectraloom.sources.tables import VISITS_SQL, micros, table, visits

DAY = 86_400_000_000
#: family, signal gate (dB), further dB for a class, least confidence, most open-set score. Fixed values.
GATES = [
    ("analog", 10.0, 3.0, 0.6, 0.5),
    ("ook-ask", 20.0, 3.0, 0.6, 0.5),
    ("fsk", 20.0, 3.0, 0.6, 0.5),
    ("psk-qam", 15.0, 5.0, 0.6, 0.5),
    ("ofdm", 10.0, 0.0, 0.6, 0.5),
    ("css", 10.0, 0.0, 0.6, 0.5),
    ("dsss", 10.0, 0.0, 0.7, 0.4),
    ("pulsed", 10.0, 0.0, 0.6, 0.5),
    ("noise-like", None, 0.0, 0.7, 1.0),
]
#: Families of the example's bands by region. Fixed values.
WEIGHTS = {0: {"analog": 1.0}, 1: {"fsk": 0.7, "analog": 0.3}, 3: {"ofdm": 0.5, "pulsed": 0.5}, 4: {"pulsed": 1.0}}
FAMILIES = sorted({f for w in WEIGHTS.values() for f in w})
BINS_SQL = "b AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS bin, unnest(embedding)::DOUBLE AS x FROM embeddings)"


def spectrum_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("bin", "x")).withColumn("x", F.col("x").cast("double"))


@query(f"""WITH {BINS_SQL}, s AS (SELECT vec_id, bin, x * x * 100 AS power, 0.4 + abs(x) AS floor FROM b), r(region, lo, hi) AS (VALUES (0, 8, 24), (1, 30, 52)),
n AS (SELECT * FROM s, r WHERE bin >= lo - round((hi - lo) * 2.0) AND bin < hi + round((hi - lo) * 2.0)),
f AS (SELECT vec_id, region, list_sort(list(floor))[count(*) // 2 + 1] AS floor_ref FROM n GROUP BY ALL),
c AS (SELECT n.vec_id, n.region, bin, floor_ref, 10 * log10(greatest(power / floor_ref, 1e-30)) AS db, greatest(power - floor_ref, 0) AS excess FROM n JOIN f USING (vec_id, region) WHERE bin >= lo AND bin < hi),
p AS (SELECT *, max(CASE WHEN db >= 3 THEN bin END) OVER (PARTITION BY vec_id, region ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM c),
g AS (SELECT *, sum((db >= 3 AND (pb IS NULL OR bin - pb - 1 >= 2))::INT) OVER (PARTITION BY vec_id, region ORDER BY bin) AS run FROM p),
e AS (SELECT *, max(CASE WHEN db >= 3 THEN bin END) OVER (PARTITION BY vec_id, region, run) AS last_hot FROM g WHERE run > 0),
t AS (SELECT *, sum(excess) OVER w AS total, sum(excess) OVER (w ORDER BY bin ROWS UNBOUNDED PRECEDING) AS up, sum(excess) OVER (w ORDER BY bin DESC ROWS UNBOUNDED PRECEDING) AS down FROM e WHERE bin <= last_hot WINDOW w AS (PARTITION BY vec_id, region, run))
SELECT vec_id, region, min(bin) FILTER (up >= total * 0.005)::INT AS first, max(bin) FILTER (down >= total * 0.005)::INT AS last, round(sum(bin * excess) / sum(excess), 6) AS centre, round(max(db), 6) AS peak_db, round(any_value(floor_ref), 6) AS floor_ref
FROM t GROUP BY vec_id, region, run HAVING max(db) >= 6""")
def region_emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is on air in two regions of every spectrum, measured anew against the floor of their surroundings."""
    b = spectrum_bins(spark, sf_dir).select("vec_id", "bin", (F.col("x") * F.col("x") * 100).alias("power"), (0.4 + F.abs("x")).alias("floor"))
    two = F.inline(F.array(*(F.struct(F.lit(i).alias("region"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for i, (lo, hi) in enumerate([(8, 24), (30, 52)]))))
    regions = table(spark, sf_dir, "embeddings").select("vec_id", two)
    rounded = {c: F.round(c, 6) for c in ("centre", "peak_db", "floor_ref")}
    return R.measured_emissions(b, regions, ["vec_id"], 6.0, 3.0).withColumns(rounded)


LOW, OVER = R.block_factors(8.0, 0.25, 1e-3)


@query(f"""WITH {BINS_SQL}, s AS (SELECT vec_id, bin // 16 AS block, CASE WHEN x * x > 0 THEN x * x END AS p FROM b), q AS (SELECT vec_id, block, quantile_cont(p, 0.25) / {LOW!r} AS floor FROM s GROUP BY ALL)
SELECT s.vec_id, s.block::BIGINT AS block, round(any_value(floor), 9) AS floor, round(avg((p > floor * {OVER!r})::INT), 9) AS occupancy, avg((p > floor * {OVER!r})::INT) < 0.5 AS valid FROM s JOIN q USING (vec_id, block) GROUP BY ALL""")
def block_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor of each 16 bins of every spectrum by a percentile, and how much of the block lies above it."""
    b = spectrum_bins(spark, sf_dir).withColumn("power", F.col("x") * F.col("x"))
    got = R.block_floors(b, ["vec_id"], F.floor(F.col("bin") / 16), "power", 8.0)
    return got.withColumns({"floor": F.round("floor", 9), "occupancy": F.round("occupancy", 9)})


@query("""WITH h AS (SELECT vec_id, list_transform(list_reverse(embedding[1:32]), lambda x: x::DOUBLE) AS d, list_transform(embedding[33:64], lambda x: x::DOUBLE) AS u FROM embeddings),
p AS (SELECT vec_id, unnest(d) AS d, unnest(u) AS u FROM h) SELECT vec_id, round(corr(u, d), 6) AS likeness FROM p GROUP BY 1""")
def mirrored_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike the two halves of every spectrum are about its middle: an image of one in the other."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(R.mirror_correlation(x), 6).alias("likeness"))


@query("""WITH s AS (SELECT event_id, lpad(bin((event_id * 2654435761) % 4294967296), 32, '0') AS bits FROM events), r AS (SELECT *, regexp_extract_all(bits, '(?:01)+0?|(?:10)+1?') AS runs FROM s),
m AS (SELECT *, list_max(list_transform(runs, lambda x: length(x))) AS n FROM r) SELECT event_id, CASE WHEN n >= 5 THEN instr(bits, list_filter(runs, lambda x: length(x) = n)[1]) - 1 END::INT AS start, CASE WHEN n >= 5 THEN n END::INT AS length FROM m""")
def preambles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternating run of five bits or more that leads each of many frames of 32 bits."""
    bits = F.lpad(F.bin((F.col("event_id") * F.lit(2_654_435_761)) % F.lit(4_294_967_296)), 32, "0")
    found = table(spark, sf_dir, "events").select("event_id", R.preamble(bits, 5).alias("p"))
    return found.select("event_id", "p.start", "p.length")


@query("""WITH e AS (SELECT l_orderkey, l_linestatus, l_returnflag, l_quantity::DOUBLE AS k FROM lineitem), b AS (SELECT *, CASE WHEN k > 10 THEN greatest(0, 100 * (k / 100 * ln(k / 100 / 0.1) + (1 - k / 100) * ln((1 - k / 100) / 0.9)) / ln(2)) ELSE 0 END AS bits FROM e),
g AS (SELECT l_orderkey, l_linestatus, l_returnflag, max(bits) AS bits, count(*) AS n FROM b GROUP BY ALL)
SELECT l_orderkey, l_linestatus, sum(n)::BIGINT AS n, round(least(sum(bits), 60) - CASE WHEN sum(n) > 1 THEN log2(sum(n)) ELSE 0 END, 6) AS bits FROM g GROUP BY ALL""")
def stage_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits for each stage of an order's search: successes of 100 against a tenth by chance, the best of each dependent group, less the search's cost."""
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_returnflag", N.binomial_tail_bits(F.col("l_quantity").cast("double"), F.lit(100.0), 0.1).alias("bits"))
    return N.stage_bits(e, ["l_orderkey", "l_linestatus"], "l_returnflag", "bits", 60.0).withColumn("bits", F.round(F.col("bits") - N.search_bits(F.col("n")), 6))


@query(f"""WITH {VISITS_SQL}, f AS (SELECT start_us // {DAY} AS tile, CASE WHEN tier <> 'error' THEN tier END AS cal, cell % 20 AS gain, level > 150 AS suspect, start_us, event_id FROM v),
r AS (SELECT tile, gain, count(*) AS n, row_number() OVER (PARTITION BY tile ORDER BY gain IS NULL, count(*) DESC, gain) AS r FROM f GROUP BY tile, gain), g AS (SELECT tile, string_agg(gain || ':' || n, ',' ORDER BY r) FILTER (gain IS NOT NULL AND r <= 4) AS gains, coalesce(sum(n) FILTER (gain IS NOT NULL AND r > 4), 0)::BIGINT AS other, coalesce(sum(n) FILTER (gain IS NULL), 0)::BIGINT AS unknown FROM r GROUP BY 1)
SELECT f.tile, count(*)::BIGINT AS frames, count_if(suspect)::BIGINT AS suspects, arg_min(struct_pack(c := cal), (start_us, event_id)).c AS calibration, (count(DISTINCT cal) + (count(cal) < count(*))::INT) > 1 AS mixed, min(start_us)::BIGINT AS first_us, max(start_us)::BIGINT AS last_us, any_value(gains) AS gains, any_value(other) AS other, any_value(unknown) AS unknown FROM f JOIN g USING (tile) GROUP BY f.tile""")
def provenance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each day's frames come from: the first calibration and whether others occur, the four commonest gains, and how many frames have others or none."""
    v = visits(spark, sf_dir).select(F.floor(F.col("start_us") / DAY).alias("tile"), F.when(F.col("tier") != "error", F.col("tier")).alias("cal"), (F.col("cell") % 20).alias("gain"), (F.col("level") > 150).alias("suspect"), "start_us", "event_id")
    return summarised(v, ["tile"], "cal", "gain", "suspect", "start_us", "event_id", 4)


def summarised(frames: DataFrame, keys: list[str], tag: str, state: str, suspect: str, t: str, tie: str, most: int) -> DataFrame:
    """Provenance by key: a tag of the first frame and whether it is mixed (none counts as a tag), and the ``most`` commonest states."""
    part = frames.groupBy(*keys, state).agg(
        F.count("*").alias("n"),
        F.count_if(suspect).alias("suspects"),
        F.min(F.struct(t, tie, tag)).alias("first"),
        F.max(t).alias("last_us"),
        F.min(tag).alias("least"),
        F.max(tag).alias("greatest"),
        F.count(tag).alias("tagged"),
    )
    known = F.col(state).isNotNull()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(~known, F.desc("n"), state))
    shown = F.when(known & (F.col("place") <= most), F.struct("place", F.concat_ws(":", F.col(state).cast("string"), F.col("n").cast("string")).alias("text")))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x.text), ",")
    out = part.withColumn("place", place).groupBy(*keys).agg(
        F.sum("n").alias("frames"),
        F.sum("suspects").alias("suspects"),
        F.min("first").alias("first"),
        ((F.min("least") != F.max("greatest")) | ((F.sum("tagged") > 0) & (F.sum("tagged") < F.sum("n")))).alias("mixed"),
        F.max("last_us").alias("last_us"),
        F.when(F.count(shown) > 0, listed).alias("gains"),
        F.coalesce(F.sum(F.when(known & (F.col("place") > most), F.col("n"))), F.lit(0)).alias("other"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("unknown"),
    )
    return out.select(*keys, "frames", "suspects", F.col(f"first.{tag}").alias("calibration"), F.coalesce("mixed", F.lit(False)).alias("mixed"), F.col(f"first.{t}").alias("first_us"), "last_us", "gains", "other", "unknown")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber AS shift, floor(l_quantity / 20)::BIGINT AS occupied FROM lineitem), b AS (SELECT l_orderkey, count(*) AS candidates, max(occupied) AS best FROM s GROUP BY 1),
w AS (SELECT s.l_orderkey, count(*) FILTER (occupied = best) AS winners, min(shift) FILTER (occupied = best) AS shift, max(occupied) FILTER (occupied < best) AS next FROM s JOIN b USING (l_orderkey) GROUP BY 1)
SELECT l_orderkey, candidates::BIGINT AS candidates, CASE WHEN candidates = 1 THEN 'bound' WHEN best = 0 THEN 'nothing occupied' WHEN winners > 1 THEN 'tied' ELSE 'energy' END AS by, CASE WHEN candidates = 1 OR (best > 0 AND winners = 1) THEN shift END::BIGINT AS shift, best, CASE WHEN candidates > 1 AND best > 0 AND winners = 1 THEN coalesce(next, 0) ELSE 0 END::BIGINT AS runner_up FROM b JOIN w USING (l_orderkey)""")
def alias_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which shift of a grid most of an order's channels speak for: one alone within the bound, the only best, or none where the best tie."""
    s = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("shift"), F.floor(F.col("l_quantity") / 20).cast("long").alias("occupied"))
    return resolved(s, ["l_orderkey"], "shift", "occupied")


def resolved(scores: DataFrame, keys: list[str], shift: str, occupied: str) -> DataFrame:
    """One row by key; a tie stays unresolved. Rows of a key are first counted by their score."""
    level = scores.groupBy(*keys, occupied).agg(F.count("*").alias("n"), F.min(shift).alias(shift))
    g = level.groupBy(*keys).agg(F.sum("n").alias("candidates"), F.max(F.struct(occupied, "n", shift)).alias("top"), F.max_by(occupied, occupied).alias("best"), F.sort_array(F.collect_list(occupied), False).alias("levels"))
    alone, won = F.col("candidates") == 1, (F.col("best") > 0) & (F.col("top.n") == 1)
    how = F.when(alone, "bound").when(F.col("best") == 0, "nothing occupied").when(~won, "tied").otherwise("energy")
    return g.select(*keys, "candidates", how.alias("by"), F.when(alone | won, F.col(f"top.{shift}")).alias(shift), "best", F.when(~alone & won, F.coalesce(F.get("levels", F.lit(1)), F.lit(0))).otherwise(0).cast("long").alias("runner_up"))


@query(f"""WITH {VISITS_SQL}, b AS (SELECT n_nationkey * 4 AS lo2, n_nationkey * 4 + 5 AS hi2, n_regionkey AS region, n_name AS band FROM nation), s AS (SELECT DISTINCT cell AS lo, cell + 2 AS hi FROM v WHERE cell IS NOT NULL),
w(region, family, w) AS (VALUES {', '.join(f"({r}, '{f}', {x})" for r, d in WEIGHTS.items() for f, x in d.items())}), m AS (SELECT lo, hi, band, region FROM s JOIN b ON lo <= hi2 AND hi >= lo2 WHERE region IN (SELECT region FROM w)),
c AS (SELECT lo, hi, count(*) AS n, string_agg(band, '+' ORDER BY band) AS bands FROM m GROUP BY ALL)
SELECT m.lo, m.hi, family, round(sum(w) / any_value(n), 9)::DOUBLE AS p, any_value(bands) AS bands FROM m JOIN w USING (region) JOIN c ON c.lo = m.lo AND c.hi = m.hi GROUP BY m.lo, m.hi, family""")
def family_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What families to expect in a band from the allocations that it meets: each that has weights has one vote."""
    b = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 4).cast("long").alias("lo2"), (F.col("n_nationkey") * 4 + 5).cast("long").alias("hi2"), F.col("n_regionkey").cast("int").alias("region"), F.col("n_name").alias("band")).where(F.col("region").isin(*WEIGHTS))
    s = visits(spark, sf_dir).where("cell is not null").select(F.col("cell").alias("lo"), (F.col("cell") + 2).alias("hi")).distinct()
    weight = lambda f: F.coalesce(*(F.when(F.col("region") == r, F.lit(w.get(f, 0.0))) for r, w in WEIGHTS.items()))
    votes = I.range_join(s, b, [], ("lo", "lo2"), ("hi", "hi2"), 8).groupBy("lo", "hi").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("band")), "+").alias("bands"), *(F.sum(weight(f)).alias(f) for f in FAMILIES))
    each = F.inline(F.array(*(F.struct(F.lit(f).alias("family"), (F.col(f) / F.col("n")).alias("p")) for f in FAMILIES)))
    return votes.select("lo", "hi", "bands", each).where("p > 0").withColumn("p", F.round("p", 9))


GATES_SQL = ", ".join(f"('{f}', {'NULL' if g is None else g}, {c}, {p}, {o})" for f, g, c, p, o in GATES)


@query(f"""WITH g(family, gate, more, least, most) AS (VALUES {GATES_SQL}), c AS (SELECT l_orderkey, l_linenumber, [{', '.join(repr(f) for f, *_ in GATES)}, 'other'][l_partkey % 10 + 1] AS family, CASE WHEN l_discount > 0.005 THEN l_quantity::DOUBLE END AS snr, 1 - l_tax::DOUBLE * 6 AS p, l_discount::DOUBLE * 8 AS open FROM lineitem),
k AS (SELECT c.*, gate IS NULL OR coalesce(snr >= gate, false) AS admitted, g.family IS NOT NULL AND p >= least AND open <= most AS sure, gate IS NULL OR coalesce(snr >= gate + more, false) AS fine FROM c LEFT JOIN g USING (family))
SELECT l_orderkey, l_linenumber, family, admitted, CASE WHEN admitted AND sure THEN family ELSE 'unknown' END AS reported, admitted AND sure AND fine AS class_called FROM k""")
def gated_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a family's gates let a call be reported, and a class within it; a signal that wasn't measured passes no gate."""
    names = F.array(*(F.lit(f) for f, *_ in GATES), F.lit("other"))
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", names[(F.col("l_partkey") % 10).cast("int")].alias("family"), F.when(F.col("l_discount") > 0.005, F.col("l_quantity").cast("double")).alias("snr"), (1 - F.col("l_tax").cast("double") * 6).alias("p"), (F.col("l_discount").cast("double") * 8).alias("open"))
    of = lambda i: F.coalesce(*(F.when(F.col("family") == g[0], F.lit(g[i]).cast("double")) for g in GATES))
    at_least = lambda bar: of(1).isNull() | F.coalesce(F.col("snr") >= bar, F.lit(False))
    sure = F.coalesce((F.col("p") >= of(3)) & (F.col("open") <= of(4)), F.lit(False))
    k = c.withColumns({"admitted": at_least(of(1)), "sure": sure, "fine": at_least(of(1) + of(2))})
    both = F.col("admitted") & F.col("sure")
    return k.select("l_orderkey", "l_linenumber", "family", "admitted", F.when(both, F.col("family")).otherwise("unknown").alias("reported"), (both & F.col("fine")).alias("class_called"))


@query("""WITH n AS (SELECT l_partkey, l_suppkey, l_returnflag = 'R' AS left_again, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS r FROM lineitem)
SELECT l_suppkey AS cluster, count(*)::BIGINT AS members, count(*) >= 3 AS promotable FROM n WHERE r = 1 AND NOT left_again GROUP BY 1""")
def cluster_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of each cluster by their latest link, those that left it not counted; three make a signature."""
    last = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")).alias("m"))
    return last.where("m.l_returnflag <> 'R'").groupBy(F.col("m.l_suppkey").alias("cluster")).agg(F.count("*").alias("members"), (F.count("*") >= 3).alias("promotable"))


@query("""WITH s AS (SELECT o_orderkey, o_custkey % 5 AS geometry, epoch_us(o_orderdate) AS t FROM orders), g AS (SELECT n_regionkey AS geometry, n_nationkey // 5 AS hop, n_nationkey * 4 AS lo, n_nationkey * 4 + 4 AS hi FROM nation),
v AS (SELECT lo, hi, t + (l_quantity * 1000)::BIGINT * 1000 AS a, least(t + (l_quantity * 1000)::BIGINT * 1000 + (l_partkey % 500) * 1000, t + 40000000) AS b FROM lineitem JOIN s ON l_orderkey = o_orderkey JOIN g ON g.geometry = s.geometry AND g.hop = l_linenumber - 1),
q AS (SELECT r_regionkey AS asked, r_regionkey * 20 + 1 AS qlo, r_regionkey * 20 + 2 AS qhi FROM region)
SELECT asked, count(*)::BIGINT AS n, sum(b - a)::BIGINT AS observed_us, max(b)::BIGINT AS last_us FROM q JOIN v ON lo <= qlo AND hi >= qhi WHERE b > a GROUP BY 1""")
def sweep_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of ranges by sweeps: each hop visit finds its window by geometry and hop, and is cut at the sweep's end."""
    s = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).alias("geometry"), micros("o_orderdate").alias("t"))
    g = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("geometry"), F.floor(F.col("n_nationkey") / 5).alias("hop"), (F.col("n_nationkey") * 4).cast("long").alias("lo"), (F.col("n_nationkey") * 4 + 4).cast("long").alias("hi"))
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_linenumber") - 1).cast("long").alias("hop"), (F.col("l_quantity") * 1000).cast("long").alias("start_ms"), (F.col("l_partkey") % 500).alias("ms"))
    hops = line.join(s, "o_orderkey").join(g, ["geometry", "hop"]).withColumn("a", F.col("t") + F.col("start_ms") * 1000)
    hops = hops.withColumn("b", F.least(F.col("a") + F.col("ms") * 1000, F.col("t") + 40_000_000)).where("b > a")
    q = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("asked"), (F.col("r_regionkey") * 20 + 1).cast("long").alias("qlo"), (F.col("r_regionkey") * 20 + 2).cast("long").alias("qhi"))
    met = I.range_join(q, hops, [], ("qlo", "lo"), ("qhi", "hi"), 8, contains=True)
    return met.groupBy("asked").agg(F.count("*").alias("n"), F.sum(F.col("b") - F.col("a")).alias("observed_us"), F.max("b").alias("last_us"))


@query(f"""WITH {VISITS_SQL}, m AS (SELECT event_id, channel, start_us, row_number() OVER (ORDER BY start_us, event_id) AS r, count(*) OVER () AS total FROM v WHERE tier = 'view' AND cell BETWEEN 10 AND 60)
SELECT event_id, channel, start_us, CASE WHEN total > 50 THEN 50 END::BIGINT AS next_cursor FROM m WHERE r > 25 AND r <= 50""")
def records_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 25 records of a tier in a box, in time order, and the cursor of the next, null after the last. The page is the feature."""
    rows = visits(spark, sf_dir).where("tier = 'view' and cell between 10 and 60").select("event_id", "channel", "start_us")
    return paged(rows, ["start_us", "event_id"], 25, 25)


def paged(rows: DataFrame, order: list, cursor: int, most: int) -> DataFrame:
    """At most ``most`` rows from the cursor on, with ``next_cursor``; one row more is read to know of a next page."""
    page = rows.orderBy(*order).offset(cursor).limit(most + 1)
    page = page.withColumns({"__r": F.row_number().over(Window.orderBy(*order)), "__n": F.count("*").over(Window.partitionBy())})
    return page.where(F.col("__r") <= most).withColumn("next_cursor", F.when(F.col("__n") > most, F.lit(cursor + most).cast("long"))).drop("__r", "__n")


@query(f"""WITH {VISITS_SQL}, c AS (SELECT channel, round(sum(CASE WHEN level >= 80 THEN end_us - start_us ELSE 0 END) / sum(end_us - start_us), 9) AS fco, round(avg((level >= 80)::INT), 9) AS fco_all, sum(end_us - start_us)::BIGINT AS observed_us FROM v WHERE level IS NOT NULL GROUP BY 1)
SELECT *, (SELECT count(*) > 10 FROM c) AS truncated FROM c ORDER BY fco DESC NULLS LAST, fco_all DESC NULLS LAST, observed_us DESC NULLS LAST, channel LIMIT 10""")
def busiest_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten channels most occupied by time, then by visits, then longest observed, and whether there are more. The limit is the feature."""
    v = visits(spark, sf_dir).where("level is not null").withColumn("us", F.col("end_us") - F.col("start_us"))
    high = F.col("level") >= 80
    c = v.groupBy("channel").agg(F.round(F.sum(F.when(high, F.col("us")).otherwise(0)) / F.sum("us"), 9).alias("fco"), F.round(F.avg(high.cast("int")), 9).alias("fco_all"), F.sum("us").alias("observed_us"))
    order = [F.desc_nulls_last("fco"), F.desc_nulls_last("fco_all"), F.desc_nulls_last("observed_us"), F.asc("channel")]
    return paged(c, order, 0, 10).withColumn("truncated", F.col("next_cursor").isNotNull()).drop("next_cursor")


@query("""WITH t AS (SELECT l_linestatus AS stage, l_returnflag AS family, l_extendedprice::DOUBLE AS score, l_orderkey, l_linenumber FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY stage, family ORDER BY score DESC, l_orderkey DESC, l_linenumber DESC) AS a, row_number() OVER (ORDER BY score DESC, l_orderkey DESC, l_linenumber DESC) AS b FROM t)
SELECT stage, family, score, l_orderkey, l_linenumber, a = 1 AS best, b <= 10 AS top FROM r WHERE a = 1 OR b <= 10""")
def kept_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of a search's traces: the best of each stage and family, and the ten best of all. The limits are the feature."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("double").alias("score"), "l_orderkey", "l_linenumber", F.col("l_linestatus").alias("stage"), F.col("l_returnflag").alias("family"))
    best = t.groupBy("stage", "family").agg(F.max(F.struct("score", "l_orderkey", "l_linenumber")).alias("m")).select("stage", "family", "m.*", F.lit(True).alias("best"), F.lit(False).alias("top"))
    top = t.orderBy(F.desc("score"), F.desc("l_orderkey"), F.desc("l_linenumber")).limit(10).withColumns({"best": F.lit(False), "top": F.lit(True)})
    keys = ["stage", "family", "score", "l_orderkey", "l_linenumber"]
    return best.unionByName(top).groupBy(*keys).agg(F.bool_or("best").alias("best"), F.bool_or("top").alias("top"))


def _sent(blocks: pd.Series) -> pd.Series:
    """A block with 16 bytes of parity as it comes in: every n-th byte of the first 8 wrong, n its length modulo 5 and one."""
    field = K.ByteField()

    def one(b: bytes) -> bytes:
        w = K.add_parity(list(b), 16, field=field)
        return bytes(x ^ 0x5A if i < 8 and i % (len(b) % 5 + 1) == 0 else x for i, x in enumerate(w))

    return blocks.map(one)


@query("""WITH b AS (SELECT page_id, i::INT AS block, substr(url, (i * 200 + 1)::INT, 200) AS text FROM (SELECT page_id, url, unnest(range((length(url) + 199) // 200)) AS i FROM pages WHERE regexp_full_match(url, '[\\x20-\\x7E]+')))
SELECT page_id, block, text, len(list_filter(range(8), lambda i: i % (length(text) % 5 + 1) = 0))::INT AS errors FROM b""")
def repaired_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ASCII url in blocks of 200 bytes, sent with parity and errors, comes back whole with its errors counted."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^[\x20-\x7E]+$"))
    b = p.select("page_id", "url", F.explode(F.sequence(F.lit(0), F.floor((F.length("url") - 1) / 200).cast("int"))).alias("block"))
    got = b.select("page_id", "block", K.correct_bytes(16)(F.pandas_udf(_sent, "binary")(F.encode(F.substr("url", F.col("block") * 200 + 1, F.lit(200)), "UTF-8"))).alias("r"))
    return got.select("page_id", "block", F.decode("r.message", "UTF-8").alias("text"), "r.errors")
