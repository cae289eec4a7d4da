"""Mergeable statistics: slot sums, histograms, percentiles, floors, pyramids and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.scalar import from_db, to_db, wilson


def slot_sums(df: DataFrame, keys: list[str], value: str, weight: str, occupied: Column, n_eff: Column) -> DataFrame:
    """Partial statistics of a slot: every column can be merged by ``merge_slots``."""
    x, w = F.col(value), F.col(weight)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_visits"),
        F.sum(x).alias("sum_db"),
        F.sum(x * x).alias("sum_sq_db"),
        F.max(x).alias("max_db"),
        F.sum(w).alias("weight_s"),
        F.sum(w * occupied.cast("int")).alias("occupied_weight_s"),
        (F.sum(w * w / F.greatest(n_eff, F.lit(1.0))) / F.sum(w)).alias("fco_var_s"),
    )


def merge_slots(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of partial slots; the sampling variance merges as a mean weighted by the weights."""
    added = [F.sum(c).alias(c) for c in ("n_visits", "sum_db", "sum_sq_db", "weight_s", "occupied_weight_s")]
    return slots.groupBy(*keys).agg(*added, F.max("max_db").alias("max_db"), (F.sum(F.col("fco_var_s") * F.col("weight_s")) / F.sum("weight_s")).alias("fco_var_s"))


def slot_measures(slots: DataFrame) -> DataFrame:
    """mean_db, std_db (sample, null under two visits) and fco of slots."""
    n = F.col("n_visits")
    spread = F.sqrt(F.greatest(F.lit(0.0), (F.col("sum_sq_db") - F.col("sum_db") * F.col("sum_db") / n) / (n - 1)))
    return slots.withColumns({"mean_db": F.col("sum_db") / n, "std_db": F.when(n > 1, spread), "fco": F.col("occupied_weight_s") / F.col("weight_s")})


def eighty_percent_floor(df: DataFrame, keys: list[str], value: str, drop: float = 0.2) -> DataFrame:
    """Power mean in dB of the lowest share 1 - drop of each group's finite values, one at least."""
    x = F.col(value)
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    by = Window.partitionBy(*keys)
    n = F.count("*").over(by)
    ranked = finite.withColumns({"__i": F.row_number().over(by.orderBy(value)), "__n": n})
    kept = F.least(F.greatest(F.round(F.col("__n") * (1 - drop)), F.lit(1.0)), F.col("__n"))
    return ranked.where(F.col("__i") <= kept).groupBy(*keys).agg(to_db(F.avg(from_db(x))).alias("floor_db"), F.count("*").alias("n_used"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, at: dict[str, float], bins: int = 1024) -> DataFrame:
    """keys and a column for each named share (0 to 1): quantiles between neighbouring values, exact, with no key held whole.

    First pass: each key's range and its counts in even bins. Second: only bins that hold a wanted rank are ranked, by their
    distinct values. Infinite values have bins of their own; null and NaN don't count, and a key of only those gets nulls.
    """
    x = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = df.select(F.struct(*keys).alias("__k"), x.alias("__x"))
    finite = F.when(F.abs("__x") < float("inf"), F.col("__x"))
    bounds = rows.groupBy("__k").agg(F.min(finite).alias("lo"), F.max(finite).alias("hi"), F.count("__x").alias("all"))
    part = F.when(F.col("hi") > F.col("lo"), (F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)).otherwise(0.0)
    bin_of = F.when(F.col("__x") == float("-inf"), -1).when(F.col("__x") == float("inf"), bins).otherwise(F.least(F.floor(part * bins), F.lit(bins - 1)))
    binned = rows.where(F.col("__x").isNotNull()).join(bounds, "__k").select("__k", bin_of.cast("int").alias("bin"), "__x", "all")
    by = Window.partitionBy("__k").orderBy("bin")
    counts = binned.groupBy("__k", "bin").agg(F.count("*").alias("n"), F.first("all").alias("all"))
    counts = counts.withColumn("before", F.sum("n").over(by) - F.col("n"))
    rank = lambda q: F.lit(float(q)) * (F.col("all") - 1)
    ends = [f(rank(q)) for q in at.values() for f in (F.floor, F.ceil)]
    wanted = counts.where(F.exists(F.array(*ends), lambda i: (i >= F.col("before")) & (i < F.col("before") + F.col("n")))).select("__k", "bin", "before")
    inside = binned.join(wanted, ["__k", "bin"]).groupBy("__k", "bin", "__x").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("all").alias("all"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy("__k", "bin").orderBy("__x")))
    found = {}
    for name, q in at.items():
        below, above = (F.min(F.when(F.col("upto") > f(rank(q)), F.col("__x"))) for f in (F.floor, F.ceil))
        share = F.first(rank(q) - F.floor(rank(q)))
        found[name] = F.when(below == above, below).otherwise(below * (1 - share) + above * share).alias(name)
    got = inside.groupBy("__k").agg(*found.values())
    return bounds.select("__k").join(got, "__k", "left").select("__k.*", *at)


def histogram(df: DataFrame, keys: list[str], value: str, lo: float, step: float, bins: int) -> DataFrame:
    """keys, bin, n: fixed bins with clamped ends; NaN and what lies below go to bin 0."""
    x = F.col(value)
    at = F.when(x.isNull() | F.isnan(x), 0).otherwise(F.least(F.greatest(F.floor((x - lo) / step), F.lit(0)), F.lit(bins - 1))).cast("int")
    return df.groupBy(*keys, at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_percentile(hist: DataFrame, keys: list[str], q: float, lo: float, step: float) -> DataFrame:
    """The percentile of binned values: the first bin whose running count reaches q % of all, its mass spread evenly."""
    by = Window.partitionBy(*keys)
    run = hist.withColumns({"__c": F.sum("n").over(by.orderBy("bin")), "__t": F.sum("n").over(by)})
    rank = F.col("__t") * (q / 100)
    hit = run.where(F.col("__c") >= rank).withColumn("__first", F.min("bin").over(by)).where(F.col("bin") == F.col("__first"))
    inside = lo + step * (F.col("bin") + F.greatest(F.lit(0.0), rank - (F.col("__c") - F.col("n"))) / F.col("n"))
    return hit.select(*keys, inside.alias("value"))


def log_histogram(df: DataFrame, keys: list[str], value: str, per_octave: int) -> DataFrame:
    """keys, bin, n over logarithmic bins of positive values."""
    return df.where(F.col(value) > 0).groupBy(*keys, F.floor(F.log2(value) * per_octave).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def pyramid_base(df: DataFrame, f: Column, t: Column, value: str, seconds: Column, occupied: Column) -> DataFrame:
    """Level 0 of a time-frequency pyramid: f, t, n, max_db, power (linear sum), cover_s, occupied_s, max_share."""
    held = F.sum(F.when(occupied, seconds).otherwise(0.0))
    return df.groupBy(f.alias("f"), t.alias("t")).agg(
        F.count("*").alias("n"),
        F.max(value).alias("max_db"),
        F.sum(from_db(F.col(value))).alias("power"),
        F.sum(seconds).alias("cover_s"),
        held.alias("occupied_s"),
        F.coalesce(held / F.sum(seconds), F.lit(0.0)).alias("max_share"),
    )


def pyramid_fold(level: DataFrame, f_factor: int, t_factor: int) -> DataFrame:
    """The next level: counts and powers add up, maxima keep, coverage is the cells' sum over the frequency factor.

    What is occupied is the best cell's share of the coverage; the largest share of any level-0 cell is kept beside it.
    """
    f, t = F.floor(F.col("f") / f_factor), F.floor(F.col("t") / t_factor)
    cover = F.sum("cover_s") / f_factor
    return level.groupBy(f.alias("f"), t.alias("t")).agg(
        F.sum("n").alias("n"),
        F.max("max_db").alias("max_db"),
        F.sum("power").alias("power"),
        cover.alias("cover_s"),
        (F.coalesce(F.max(F.col("occupied_s") / F.nullif(F.col("cover_s"), F.lit(0.0))), F.lit(0.0)) * cover).alias("occupied_s"),
        F.max("max_share").alias("max_share"),
    )


def roll_up(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Occupancy rows joined to one.

    ``fco`` is weighted by observed time times the share of visits that aren't suspect, ``fco_all`` by visits, ``fco_upper``
    and ``fbo`` by observed time, each over the rows that have it; independent samples add up over rows with an ``fco`` and
    give its interval; the longest revisit and the median threshold stay, flags join by or.
    """

    def weighted(x: str, w: Column) -> Column:
        w = F.when(F.col(x).isNotNull(), w)
        return F.sum(F.col(x) * w) / F.nullif(F.sum(w), F.lit(0.0))

    seconds, n = F.col("observed_s"), F.col("n_revisits")
    usable = F.when(n > 0, seconds * (n - F.col("n_suspect")) / n).otherwise(0.0)
    out = rows.groupBy(*keys).agg(
        weighted("fco", usable).alias("fco"),
        weighted("fco_all", n.cast("double")).alias("fco_all"),
        weighted("fco_upper", seconds).alias("fco_upper"),
        weighted("fbo", F.greatest(seconds, F.lit(1e-9))).alias("fbo"),
        *(F.sum(c).alias(c) for c in ("n_revisits", "n_occupied", "n_suspect", "observed_s")),
        F.max("revisit_max_s").alias("revisit_max_s"),
        F.percentile("threshold_db", F.lit(0.5)).alias("threshold_db"),
        F.bool_or("clamped").alias("clamped"),
        F.coalesce(F.sum(F.when(F.col("fco").isNotNull(), F.col("n_eff"))), F.lit(0.0)).alias("n_eff"),
    )
    return out.withColumn("interval", F.when(F.col("fco").isNotNull(), wilson(F.col("fco"), F.col("n_eff"))))


def mode_of(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The commonest value, the least among equals."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value), F.max("n").alias("n"))


def votes(df: DataFrame, keys: list[str], value: str, least: int) -> DataFrame:
    """Values that ``least`` or more rows of a key agree on, the leader marked."""
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), value)
    return counted.withColumn("leads", F.row_number().over(by) == 1)
