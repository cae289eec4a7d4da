"""Density clusters of points in the plane, and class distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spectraloom.operators.graph import connected_components
from spectraloom.sources.shared import Steps, written


#: Cells a reach: two rows of one cell are in reach of each other, and rows in reach lie at most two cells apart each way.
_CELLS = 1.5


def _around(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row of cells i, j once for each step, ``near_i`` and ``near_j`` being the cell there."""
    step = F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in steps)))
    return df.withColumn("__s", step).withColumns({"near_i": F.col("i") + F.col("__s.p"), "near_j": F.col("j") + F.col("__s.q")}).drop("__s")


def _linked(cores: DataFrame, reach: float, steps: Steps) -> DataFrame:
    """cell, cluster: cells of cores (named by their least core) and the least of the cells that their links lead to.

    Cells next to each other are linked if two of their cores are in reach. The outermost cores of eight directions mostly tell; only
    where they don't, and the cells aren't in one cluster anyway, cores meet in pairs: those in reach of the other cell's bounds.
    """
    ways = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (-1, -1), (1, -1), (-1, 1)]
    outer = F.array(*(F.max_by(F.struct("x", "y"), F.struct(p * F.col("x") + q * F.col("y"), "x", "y")) for p, q in ways))
    cells = cores.groupBy("i", "j").agg(F.min("row").alias("cell"), outer.alias("outer"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    cells = steps.written(cells, "cells")
    half = [(p, q) for p in range(3) for q in range(-2, 3) if (p, q) > (0, 0)]
    there = cells.select(F.col("i").alias("near_i"), F.col("j").alias("near_j"), F.col("cell").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ("outer", "x0", "x1", "y0", "y1")))
    two = _around(cells.withColumnRenamed("cell", "a"), half).join(there, ["near_i", "near_j"])
    beside = lambda c: F.greatest(F.col(f"{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"{c}1"), F.lit(0.0))
    two = two.where(F.pow(beside("x"), 2) + F.pow(beside("y"), 2) <= reach * reach * (1 + 1e-9))
    meet = F.exists("outer", lambda u: F.exists("b_outer", lambda v: F.pow(u["x"] - v["x"], 2) + F.pow(u["y"] - v["y"], 2) <= reach * reach))
    two = steps.written(two.select("a", "b", meet.alias("sure"), *(F.struct(*(F.col(f"{o}{c}").alias(c) for c in ("x0", "x1", "y0", "y1"))).alias(f"{n}_box") for n, o in (("a", ""), ("b", "b_")))), "cell_pairs")
    sure = two.where("sure").select("a", "b")
    roots = steps.written(connected_components(sure), "roots")
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    open_ = two.where("not sure").join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("a_root", "a") != F.coalesce("b_root", "b"))
    places = cores.select("i", "j", "x", "y").distinct().join(cells.select("i", "j", "cell"), ["i", "j"]).select("cell", "x", "y")

    def side(one: str, other: str) -> DataFrame:
        off = lambda c: F.greatest(F.col(f"{other}_box.{c}0") - F.col(c), F.col(c) - F.col(f"{other}_box.{c}1"), F.lit(0.0))
        met = open_.join(places.withColumnRenamed("cell", one), one).where(F.pow(off("x"), 2) + F.pow(off("y"), 2) <= reach * reach * (1 + 1e-9))
        return met.select("a", "b", F.col("x").alias(f"{one}x"), F.col("y").alias(f"{one}y"))

    close = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2) <= reach * reach
    found = side("a", "b").join(side("b", "a"), ["a", "b"]).where(close).select("a", "b").distinct()
    ends = steps.written(connected_components(sure.unionByName(found)), "clusters")
    return cells.select("i", "j", "cell").join(ends, F.col("cell") == F.col("node"), "left").select("i", "j", F.coalesce("root", "cell").alias("cluster"))


def density_clusters(points: DataFrame, row: str, x: str, y: str, reach: float, least: int) -> DataFrame:
    """row, cluster: rows with ``least`` rows within reach, themselves included, are cores; cores in reach share a cluster,
    named by its least core; other rows join the least cluster in reach, or none (null).

    Pairs of rows aren't made. Rows at one place count as one with a weight, and a cell of a grid whose rows are all in reach of each
    other holds only cores once it has ``least`` of them; so only rows of cells with fewer look at the cells around, and a row meets
    at most ``least`` rows of each of those. Clusters are components of cells.
    """
    steps = Steps(points.sparkSession)
    at = lambda c: F.floor(F.col(c) * _CELLS / reach)
    known = points.select(F.col(row).alias("row"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("row").isNotNull() & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf")))
    places = known.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("row").alias("row")).withColumns({"i": at("x"), "j": at("y")})
    places = steps.written(places, "places")
    held = places.groupBy("i", "j").agg(F.sum("n").alias("held"))
    counted = steps.written(places.join(held, ["i", "j"]), "counted")
    around = [(p, q) for p in range(-2, 3) for q in range(-2, 3)]
    near = F.pow(F.col("x") - F.col("bx"), 2) + F.pow(F.col("y") - F.col("by"), 2) <= reach * reach
    few = _around(counted.where(F.col("held") < least), around)
    others = counted.select(F.col("i").alias("near_i"), F.col("j").alias("near_j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("n").alias("m"))
    seen = few.join(others, ["near_i", "near_j"]).where(near).groupBy("x", "y").agg(F.sum("m").alias("seen"))
    cored = counted.join(seen, ["x", "y"], "left").withColumn("core", (F.col("held") >= least) | (F.coalesce("seen", F.lit(0)) >= least))
    cored = steps.written(cored.select("x", "y", "i", "j", "row", "core"), "cores")
    cluster = _linked(cored.where("core"), reach, steps)
    own = cored.where("core").join(cluster, ["i", "j"]).select("x", "y", "cluster", "i", "j")
    of_core = own.select(F.col("i").alias("near_i"), F.col("j").alias("near_j"), F.col("x").alias("bx"), F.col("y").alias("by"), "cluster")
    rim = _around(cored.where("not core"), around).join(of_core, ["near_i", "near_j"]).where(near).groupBy("x", "y").agg(F.min("cluster").alias("cluster"))
    named = written(own.select("x", "y", "cluster").unionByName(rim), "named")
    steps.drop()
    found = points.select(F.col(row), F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    return found.join(named, (F.col("__x") == named["x"]) & (F.col("__y") == named["y"]), "left").select(row, "cluster")


#: The largest posterior of the unknown and of any other class, and how many times the runner-up dominant evidence is. Fixed values.
UNKNOWN_CAP, CLASS_CAP, DOMINANCE = 0.9, 0.999, 10.0


def fused(df: DataFrame, key: str, label: str, likelihood: str, prior: str, open_set: str, unknown: str = "unknown") -> DataFrame:
    """key, label, posterior, exponent of likelihoods over classes (one row each, the ``unknown`` among them).

    The unknown class gets the larger of its likelihood and the key's open-set score, capped, and no prior scales it. The
    others share the rest by likelihood times prior to a power, evenly where all likelihoods are 0. The power is 1, but
    where the prior would overturn evidence that dominates the runner-up, it is lowered by bisection until that leads again.
    What the leader has above its cap goes to the runner-up. A null likelihood is 0, a null or negative prior too.
    """
    number = lambda c: F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    row = F.struct(F.col(label).alias("label"), number(likelihood).alias("l"), number(prior).alias("prior"))
    known = F.col(label).isNull() | (F.col(label) != unknown)
    g = df.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(known, row))).alias("known"),
        F.coalesce(F.max(F.when(~known, number(likelihood))), F.lit(0.0)).alias("own"),
        F.coalesce(F.max(open_set), F.lit(0.0)).alias("open"),
        F.max(~known).alias("asked"),
    )
    weights = lambda tau: F.transform("known", lambda x: x["l"] * F.when(tau == 0, 1.0).otherwise(F.pow(x["prior"], tau)))
    leader = lambda w: F.array_max(F.transform(w, lambda x, i: F.struct(x.alias("w"), (-i).alias("i"))))["i"]
    ranked = F.reverse(F.array_sort(F.transform("known", lambda x: x["l"])))
    top, second = F.get(ranked, F.lit(0)), F.coalesce(F.get(ranked, F.lit(1)), F.lit(0.0))
    g = g.withColumns({"unknown": F.least(F.greatest("own", F.least("open", F.lit(1.0))), F.lit(UNKNOWN_CAP)), "best": leader(weights(F.lit(0.0))), "prior_best": leader(weights(F.lit(1.0)))})
    dominant = (top > 0) & ((second <= 0) | (top / second >= DOMINANCE))

    def halve(span: Column, _: Column) -> Column:
        mid = (span["lo"] + span["hi"]) / 2
        holds = leader(weights(mid)) == F.col("best")
        return F.struct(F.when(holds, mid).otherwise(span["lo"]).alias("lo"), F.when(holds, span["hi"]).otherwise(mid).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), halve)["lo"]
    g = g.withColumn("exponent", F.when((F.col("best") != F.col("prior_best")) & dominant, found).otherwise(1.0)).withColumn("w", weights(F.col("exponent")))
    total = F.aggregate("w", F.lit(0.0), lambda a, x: a + x)
    share = F.transform("known", lambda x, i: F.struct(x["label"].alias("label"), ((1 - F.col("unknown")) * F.when(total > 0, F.get("w", i) / total).otherwise(1 / F.size("w"))).alias("p"), F.lit(CLASS_CAP).alias("cap")))
    whole = F.when(F.col("asked"), F.concat(share, F.array(F.struct(F.lit(unknown).alias("label"), F.col("unknown").alias("p"), F.lit(UNKNOWN_CAP).alias("cap"))))).otherwise(share)
    each = g.select(key, "exponent", whole.alias("dist"))
    mass = F.aggregate("dist", F.lit(0.0), lambda a, x: a + x["p"])
    each = each.withColumn("dist", F.transform("dist", lambda x, i: F.struct((x["p"] / mass).alias("p"), i.alias("i"), x["label"].alias("label"), x["cap"].alias("cap"))))
    each = each.withColumn("order", F.reverse(F.array_sort("dist")))
    excess = F.greatest(F.get("order", F.lit(0))["p"] - F.get("order", F.lit(0))["cap"], F.lit(0.0))
    capped = F.transform("order", lambda x, i: F.struct(x["label"].alias("label"), (x["p"] + F.when(i == 0, -excess).when(i == 1, excess).otherwise(0.0)).alias("posterior")))
    return each.select(key, "exponent", F.explode(capped).alias("d")).select(key, F.col("d.label").alias(label), F.col("d.posterior").alias("posterior"), "exponent")


def softmax(logits: Column, temperature: float) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda z: F.exp((z - top) / temperature))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, q: a + q))


def look_elsewhere(p: Column, trials: Column) -> Column:
    """Chance that the best of some trials is as good, from the chance of one."""
    return F.when(p >= 1, 1.0).otherwise(-F.expm1(trials * F.log1p(-p)))
