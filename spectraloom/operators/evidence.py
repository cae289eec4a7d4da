"""Evidence rules: content correlation of two paths, recipe ranking, independent checks, interference and false positions."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the multipath rule: least correlation, least dominance, longest delay (s), least delay in resolutions,
# least overlap (s), least supporting parts and their share, most self-similarity, level slack and most attenuation (dB).
PATH_RULE = {"peak": 0.75, "dominance": 1.5, "delay": 0.150, "resolutions": 2.0, "overlap": 2.0, "support": 3, "share": 0.5, "itself": 0.7, "slack": 1.0, "attenuation": 40.0}
# Fixed values of the recipe ranking: weights of the fields, least score, score of a fit, least fields compared.
RECIPE_WEIGHTS = {"family": 3.0, "rate": 2.0, "bandwidth": 1.5, "bursty": 1.0, "feature": 1.0}
LEAST_SCORE, FIT_SCORE, LEAST_COMPARED = 0.2, 0.8, 2
# Fixed values of the interference and position rules.
FLOOR_RISE_DB, DROP_DB, ALL_SHARE, EQUAL_POWER_DB, FASTEST, CLOCK_RATE = 6.0, 6.0, 0.8, 1.5, 340.0, 1e-5


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation, null where a side doesn't vary (the built-in fails there)."""
    return F.when((F.max(x) > F.min(x)) & (F.max(y) > F.min(y)), F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def lag_correlations(series: DataFrame, pairs: DataFrame, key: str, slot: str, value: str, most: int) -> DataFrame:
    """a, b, lag, n, r: correlation of ``a``'s series with ``b``'s ``lag`` slots later, for lags of at most ``most``.

    Each slot of a pair meets one slot for each lag in an equi-join, and the sums are partial before they are shuffled.
    Lags with fewer than two common slots, or with a constant side, are left out.
    """
    x = pairs.select("a", "b").join(series.select(F.col(key).alias("a"), F.col(slot).alias("__at"), F.col(value).cast("double").alias("__x")), "a")
    x = x.withColumn("lag", F.explode(F.sequence(F.lit(-most), F.lit(most)))).withColumn("__at", F.col("__at") + F.col("lag"))
    y = series.select(F.col(key).alias("b"), F.col(slot).alias("__at"), F.col(value).cast("double").alias("__y"))
    met = x.join(y, ["b", "__at"]).groupBy("a", "b", "lag")
    return met.agg(F.count("*").alias("n"), correlation("__x", "__y").alias("r")).where("r is not null").select("a", "b", "lag", "n", "r")


def best_delay(correlations: DataFrame, near: int = 1) -> DataFrame:
    """a, b, lag, n, peak, dominance: the best lag (ties: the shortest, then the earlier) over the best one more than ``near`` away.

    With no such positive rival the dominance is infinite.
    """
    at = correlations.groupBy("a", "b").agg(F.collect_list(F.struct("r", (-F.abs("lag")).alias("short"), (-F.col("lag")).alias("early"), "lag", "n")).alias("all"))  # one a lag
    best = at.withColumn("best", F.array_max("all"))
    rival = F.array_max(F.transform(F.filter("all", lambda s: F.abs(s["lag"] - F.col("best.lag")) > near), lambda s: s["r"]))
    return best.withColumn("rival", rival).select("a", "b", "best.lag", "best.n", F.col("best.r").alias("peak"), F.when(F.col("rival") > 0, F.col("best.r") / F.col("rival")).otherwise(float("inf")).alias("dominance"))


def path_support(series: DataFrame, delays: DataFrame, key: str, slot: str, value: str, part: int, least: float = 0.5) -> DataFrame:
    """a, b, segments, support: parts of ``part`` slots that have a correlation at the best lag, and those where it reaches ``least``."""
    x = delays.select("a", "b", "lag").join(series.select(F.col(key).alias("a"), F.col(slot).alias("__at"), F.col(value).cast("double").alias("__x")), "a")
    x = x.withColumn("__part", F.floor(F.col("__at") / part)).withColumn("__at", F.col("__at") + F.col("lag"))
    y = series.select(F.col(key).alias("b"), F.col(slot).alias("__at"), F.col(value).cast("double").alias("__y"))
    r = x.join(y, ["b", "__at"]).groupBy("a", "b", "__part").agg(correlation("__x", "__y").alias("r")).where("r is not null")
    return r.groupBy("a", "b").agg(F.count("*").alias("segments"), F.count(F.when(F.round("r", 9) >= least, 1)).alias("support"))


def path_verdict(identity_a: Column, identity_b: Column, overlap: Column, resolution: Column, peak: Column, dominance: Column, support: Column, segments: Column, itself: Column, lag: Column, level_a: Column, level_b: Column, rule: dict = PATH_RULE) -> Column:
    """related, independent or undecidable: is ``b`` the same emission over a second path (or ``a``, with a negative lag)?

    A null is an absent measurement: it decides nothing, but two unlike identities decide first. A null ``itself`` counts as none.
    """
    delay = F.abs(lag)
    lost = F.when(lag > 0, level_a - level_b).otherwise(level_b - level_a)
    known = lambda c: c.isNotNull() & ~F.isnan(c)
    return (
        F.when(identity_a != identity_b, "independent")
        .when(~known(overlap) | (overlap < rule["overlap"]) | ~known(resolution) | (resolution <= 0), "undecidable")
        .when(~known(peak) | (peak < rule["peak"]), "independent")
        .when(~known(dominance) | (dominance < rule["dominance"]), "undecidable")
        .when(F.coalesce(segments, F.lit(0)) == 0, "undecidable")
        .when((support < rule["support"]) | (support < rule["share"] * segments) | F.coalesce(itself >= rule["itself"], F.lit(False)), "undecidable")
        .when(~known(lag) | (delay <= rule["resolutions"] * resolution), "undecidable")
        .when(delay > rule["delay"], "independent")
        .when(lost.isNull() | (lost < -rule["slack"]) | (lost > rule["attenuation"]), "undecidable")
        .otherwise("related")
    )


def outside(x: Column, lo: Column, hi: Column) -> Column:
    """Distance of ``x`` from a range in its half-widths, or in quarters of the nearer edge where those are larger."""
    edge = F.when(x < lo, lo).otherwise(hi)
    scale = F.greatest((hi - lo) / 2, F.abs(edge) * 0.25)
    return F.when((x >= lo) & (x <= hi), 0.0).when(scale > 0, F.abs(x - edge) / scale).otherwise(float("inf"))


RECIPE = ("id string", "families array<string>", "bandwidth struct<lo:double,hi:double>", "rate struct<lo:double,hi:double>", "bursty boolean", "features array<string>", "band struct<lo:double,hi:double>")


def catalogue(recipes: list[tuple]) -> Column:
    """The caller's recipes as one literal array of structs."""
    names = [f.split()[0] for f in RECIPE]
    rows = [{k: {"lo": v[0], "hi": v[1]} if isinstance(v, tuple) else v for k, v in zip(names, r)} for r in recipes]
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{', '.join(f.replace(' ', ':', 1) for f in RECIPE)}>>")


def rank_recipes(measured: DataFrame, recipes: list[tuple], row: str) -> DataFrame:
    """Every (measurement, recipe): score, outcome, counts of fields, why it is ruled out (else null), rank among the offered.

    ``measured`` has family, bandwidth, rate, bursty, features and centre, null where unknown. A field that was not measured
    earns nothing and rules nothing out; a family that the recipe doesn't decode rules it out, but not one whose finer
    families (``family/…``) it decodes. ``recipes`` is a catalogue in the order of ``RECIPE``; it travels as a literal.
    """
    family = F.col("family")
    unknown = family.isNull() | (family == "unknown")
    none = F.lit(None).cast("double")
    lower = F.transform(F.coalesce("features", F.array()), lambda f: F.lower(f))

    def compared(recipe: Column) -> Column:
        """The recipe's declared fields, each a weight and a distance that is null where it was not measured."""
        away = lambda x, name: F.when(F.col(x).isNotNull() & ~F.isnan(x), outside(F.col(x), recipe[name]["lo"], recipe[name]["hi"]))
        field = lambda there, weight, z: F.when(there, F.struct(F.lit(RECIPE_WEIGHTS[weight]).alias("w"), z.alias("z")))
        fields = F.array(
            field(F.size(F.coalesce(recipe["families"], F.array())) > 0, "family", F.when(~unknown & F.array_contains(recipe["families"], family), 0.0).otherwise(none)),
            field(recipe["bandwidth"].isNotNull(), "bandwidth", away("bandwidth", "bandwidth")),
            field(recipe["rate"].isNotNull(), "rate", away("rate", "rate")),
            field(recipe["bursty"].isNotNull(), "bursty", F.when(F.col("bursty") == recipe["bursty"], 0.0).when(F.col("bursty") != recipe["bursty"], 4.0)),
        )
        marks = F.transform(F.coalesce(recipe["features"], F.array()), lambda f: F.struct(F.lit(RECIPE_WEIGHTS["feature"]).alias("w"), F.when(F.array_contains(lower, F.lower(f)), 0.0).alias("z")))
        return F.concat(F.filter(fields, lambda s: s.isNotNull()), marks)

    # Exploded with their fields, which are so built once for each pair and not again in every measure below.
    m = measured.withColumn("__p", F.explode(F.transform(catalogue(recipes), lambda r: F.struct(r.alias("recipe"), compared(r).alias("f"))))).select(row, "family", "centre", "__p.recipe", F.col("__p.f").alias("__f"))
    h = lambda name: F.col("recipe")[name]
    families = F.coalesce(h("families"), F.array())
    said = F.size(families) > 0
    agrees = F.array_contains(families, family)
    coarse = F.exists(families, lambda f: f.startswith(F.concat(family, F.lit("/"))))
    total = lambda f: F.aggregate("__f", F.lit(0.0), f)
    earned = total(lambda a, s: a + s["w"] * F.coalesce(F.exp(-0.5 * s["z"] * s["z"]), F.lit(0.0)))
    count = lambda f: F.size(F.filter("__f", f)).cast("long")
    m = m.withColumns(
        {
            "score": F.when(F.size("__f") > 0, F.round(earned / total(lambda a, s: a + s["w"]), 9)).otherwise(0.0),
            "compared": count(lambda s: s["z"].isNotNull()),
            "agreed": count(lambda s: s["z"] <= 1),
            "conflicting": count(lambda s: s["z"] > 3),
            "unmeasured": count(lambda s: s["z"].isNull()),
            "__hint": F.coalesce((F.col("centre") >= h("band")["lo"]) & (F.col("centre") <= h("band")["hi"]), F.lit(False)),
        }
    )
    reason = (
        F.when(F.size("__f") == 0, "no expectations")
        .when(said & ~F.coalesce(unknown | agrees | coarse, F.lit(True)), "other family")
        .when(F.col("compared") < LEAST_COMPARED, "too few compared")
        .when(F.col("score") < LEAST_SCORE, "low score")
    )
    m = m.withColumn("reason", reason)
    outcome = F.when(F.col("reason").isNotNull(), "none").when((F.col("score") >= FIT_SCORE) & (F.col("conflicting") == 0), "fit").otherwise("partial")
    order = [F.col("reason").isNull().desc(), F.desc("score"), F.desc("__hint"), F.desc("agreed"), "unmeasured", h("id")]
    place = F.row_number().over(Window.partitionBy(row).orderBy(*order)).cast("long")  # as many rows as the catalogue
    return m.withColumn("rank", F.when(F.col("reason").isNull(), place)).select(row, h("id").alias("recipe"), "score", outcome.alias("outcome"), "compared", "agreed", "conflicting", "unmeasured", "reason", "rank")


def basis(vectors: Iterable[int], least: dict[int, int] | None = None) -> dict[int, int]:
    """A basis over two-element arithmetic by highest bit."""
    out = dict(least or {})
    for v in vectors:
        while v and v.bit_length() in out:
            v ^= out[v.bit_length()]
        if v:
            out[v.bit_length()] = v
    return out


def _basis_rows(keys: list[str]):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        found = basis(int.from_bytes(v, "big") for v in frame["vector"])
        size = len(frame["vector"].iloc[0])
        out = pd.DataFrame({"vector": [v.to_bytes(size, "big") for v in found.values()]})
        for k in [*keys, "length"]:
            out[k] = frame[k].iloc[0]
        return out[[*keys, "length", "vector"]]

    return run


def polynomial():
    """A pandas UDF: a frame without its outer zero bits, so that shifts are equal. Null if one pattern of at most 16 bits fills it."""

    def core(x: bytes) -> bytes | None:
        bits = "".join(f"{b:08b}" for b in x)
        if any(bits[p:] == bits[:-p] for p in range(1, 17) if 2 * p <= len(bits)):
            return None
        bits = bits.strip("0")
        return int(bits, 2).to_bytes((len(bits) + 7) // 8, "big") if bits else None

    @F.pandas_udf("binary")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(core, na_action="ignore")

    return run


def check_tally(frames: DataFrame, keys: list[str], raw: str, salts: int = 16) -> DataFrame:
    """keys, tested, distinct, independent: of frames that passed their check, how many are chance events of their own.

    Frames filled by a short pattern, and shifts and repeats of a frame, add none; nor do sums of others of their length: no
    more count than the affine rank plus one, which is the rank with a one put before every frame. A hot key is spread: each
    part of it leaves a basis, at most as many vectors as a frame has bits, and the bases are merged. Null frames are tested only.
    """
    tested = frames.groupBy(*keys).agg(F.count("*").alias("tested"))
    cores = frames.select(*keys, raw).distinct().withColumn("core", polynomial()(raw)).where("core is not null")
    distinct = cores.groupBy(*keys).agg(F.countDistinct("core").alias("distinct"))
    vectors = cores.select(*keys, F.octet_length(raw).alias("length"), F.concat(F.unhex(F.lit("01")), raw).alias("vector"))
    kinds = ", ".join(f"{k} {frames.schema[k].dataType.simpleString()}" for k in keys) + ", length int, vector binary"
    parts = vectors.withColumn("__salt", F.pmod(F.xxhash64("vector"), F.lit(salts))).groupBy(*keys, "length", "__salt").applyInPandas(_basis_rows(keys), kinds)
    whole = parts.groupBy(*keys, "length").applyInPandas(_basis_rows(keys), kinds)
    rank = whole.groupBy(*keys).agg(F.count("*").alias("rank"))
    out = tested.join(distinct, keys, "left").join(rank, keys, "left")
    return out.select(*keys, "tested", F.coalesce("distinct", F.lit(0)).alias("distinct"), F.coalesce(F.least("distinct", "rank"), F.lit(0)).alias("independent"))


def jamming(rise: Column, before: Column, now: Column, drop: Column) -> Column:
    """struct(verdict, confidence): a raised floor is interference; satellites lost without one are obstruction.

    ``before`` null means no receiver: the floor decides alone. Other nulls count as no change.
    """
    raised = F.coalesce(rise >= FLOOR_RISE_DB, F.lit(False))
    lost = F.greatest(F.coalesce(before - now, F.lit(0)), F.lit(0))
    every = F.coalesce((before > 0) & (lost / F.nullif(before, F.lit(0)) >= ALL_SHARE), F.lit(False))
    some = before.isNotNull() & ((lost > 0) | F.coalesce(drop >= DROP_DB, F.lit(False)))
    verdict = F.when(raised, "jamming").when(some, "blockage").otherwise("quiet")
    confidence = F.when(raised & every, 0.95).when(raised & some, 0.75).when(raised | some, 0.6).otherwise(0.0)
    return F.struct(verdict.alias("verdict"), confidence.alias("confidence"))


def false_positions(epochs: DataFrame, key: str, t: str, tie: str) -> DataFrame:
    """key, equal_power, position_jumps, clock_jumps, confidence: signs of a false constellation over a receiver's epochs.

    ``epochs`` has locked, spread_db, x, y (m) and clock (s), null where unknown; ``t`` is in seconds. Epochs at one time
    are not compared. Distinct kinds of sign raise the confidence, repeats don't.
    """
    by = Window.partitionBy(key).orderBy(t, tie)
    before = lambda c: F.lag(c).over(by)
    e = epochs.withColumns({"__dt": F.col(t) - before(t), "__m": F.hypot(F.col("x") - before("x"), F.col("y") - before("y")), "__c": F.abs(F.col("clock") - before("clock"))})
    later = F.col("__dt") > 0
    count = lambda c: F.count(F.when(c, 1))
    found = e.groupBy(key).agg(
        count((F.col("locked") >= 4) & (F.col("spread_db") < EQUAL_POWER_DB)).alias("equal_power"),
        count(later & (F.col("__m") / F.when(later, F.col("__dt")) > FASTEST)).alias("position_jumps"),
        count(later & (F.col("__c") / F.when(later, F.col("__dt")) > CLOCK_RATE)).alias("clock_jumps"),
    )
    kinds = sum((F.col(c) > 0).cast("int") for c in ("equal_power", "position_jumps", "clock_jumps"))
    return found.withColumn("confidence", F.element_at(F.array(*[F.lit(x) for x in (0.0, 0.5, 0.8, 0.95)]), kinds + 1))
