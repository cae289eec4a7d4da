"""Joins that Spark has no word for: as-of, interpolation, closures, scored and greedy matching, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from spectraloom.functions.scalar import clip
from spectraloom.sources.shared import Steps, scratch, spread, written


def as_of(left: DataFrame, right: DataFrame, key: str, t: str, value: str, tie: str) -> DataFrame:
    """``left`` (key, t, tie) with the newest ``value`` of ``right`` (key, t, value) at or before its time; one shuffle."""
    both = left.select(key, t, tie, F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias(value))
    both = both.unionByName(right.select(key, t, F.lit(None).cast(left.schema[tie].dataType).alias(tie), F.lit(0).alias("__side"), value))
    by = Window.partitionBy(key).orderBy(t, "__side", tie, value).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, True).over(by)).where("__side = 1").drop("__side")


def interpolated(points: DataFrame, table: DataFrame, keys: list[str], x: str, y: str, tie: str) -> DataFrame:
    """``points`` (keys, x, tie) with y on the straight line between the table's bracketing rows; flat beyond its ends."""
    known = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    both = points.select(*keys, x, tie, F.lit(1).alias("__side"), F.lit(None).cast("struct<x:double,y:double>").alias("__k"))
    both = both.unionByName(table.select(*keys, x, F.lit(None).cast(points.schema[tie].dataType).alias(tie), F.lit(0).alias("__side"), known.cast("struct<x:double,y:double>").alias("__k")))
    by = Window.partitionBy(*keys).orderBy(x, "__side")
    a = F.last("__k", True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first("__k", True).over(by.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"__a": a, "__b": b})
    a, b = F.col("__a"), F.col("__b")
    line = F.when(b["x"] == a["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"]))
    return both.where("__side = 1").withColumn(y, F.when(a.isNull(), b["y"]).when(b.isNull(), a["y"]).otherwise(line)).drop("__side", "__k", "__a", "__b")


def follow_merges(links: DataFrame, child: str, parent: str) -> DataFrame:
    """child, parent, root: the end of each child's chain of merges, however long.

    Every round doubles the reach, so there are as many rounds as the longest chain has binary digits. More rounds than the
    number of links has mean a circle, which is an error. Links with a null are left out, repeated ones count once.
    """
    steps = Steps(links.sparkSession)
    links = links.select(child, parent).dropna().distinct()
    at = steps.written(links.select(F.col(child).alias("c"), F.col(parent).alias("p")), "chains")
    for _ in range(at.count().bit_length() + 1):
        hop = at.select(F.col("c").alias("p"), F.col("p").alias("q"))
        further = at.join(hop, "p", "left").select("c", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved"))
        further = steps.written(further.distinct(), "chains")
        at = further.select("c", "p").distinct()
        if further.where("moved").isEmpty():
            found = written(links.join(at.select(F.col("c").alias(child), F.col("p").alias("root")), child), "merges")
            steps.drop()
            return found
    steps.drop()
    raise ValueError("merges run in a circle")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], first: str, last: str, rest: list[str]) -> DataFrame:
    """Both tables by key: the earliest ``first``, the latest ``last``, and the other columns of the row seen last."""
    both = old.select(*keys, first, last, *rest, F.lit(0).alias("__n")).unionByName(new.select(*keys, first, last, *rest, F.lit(1).alias("__n")))
    newest = F.max_by(F.struct(*rest), F.struct(last, "__n")).alias("__r")
    return both.groupBy(*keys).agg(F.min(first).alias(first), F.max(last).alias(last), newest).select(*keys, first, last, "__r.*")


def time_bucket_pairs(left: DataFrame, right: DataFrame, on: list[tuple[str, str]], t_left: str, t_right: str, window: int) -> DataFrame:
    """Pairs by equal keys whose times are at most ``window`` apart: the right side goes to its bucket and both neighbours.

    A few rows give many pairs, so the join keeps its tasks, whatever its rows' bytes.
    """
    a = spread(left.withColumn("__a", F.floor(F.col(t_left) / window)), "__a", *(x for x, _ in on))
    b = right.withColumn("__b", F.explode(F.sequence(F.floor(F.col(t_right) / window) - 1, F.floor(F.col(t_right) / window) + 1)))
    same = F.col("__a") == F.col("__b")
    for x, y in on:
        same = same & (F.col(x) == F.col(y))
    return a.join(spread(b, "__b", *(y for _, y in on)), same & (F.abs(F.col(t_left) - F.col(t_right)) <= window)).drop("__a", "__b")


def longitude_cells(lat: Column, lon: Column, km: float, rise: float, width: int) -> Column:
    """The cells of longitude, ``width`` degrees each from -180, in which places at most ``km`` away and ``rise`` degrees up or down may lie.

    Such a place has (sin(km / 2R))^2 >= cos(lat) cos(its lat) (sin(dlon / 2))^2. Near a pole, and beyond it, it may be anywhere.
    """
    edge = F.abs(lat) + rise
    sine = F.sin(F.lit(km / 2 / 6371.0)) / F.sqrt(F.cos(F.radians(lat)) * F.cos(F.radians(edge)))
    reach = F.when((edge < 80) & (sine < 1), F.degrees(2 * F.asin(sine)) + 1e-6).otherwise(F.lit(180.0))
    cell = lambda x: F.floor((x + 180) / width)
    return F.array_distinct(F.transform(F.sequence(cell(lon - reach), cell(lon + reach)), lambda c: F.pmod(c, F.lit(360 // width).cast("long"))))


def greedy_one_to_one(pairs: DataFrame, a: str, b: str, cost: str) -> DataFrame:
    """Of candidate pairs those that a pass by rising cost would take, each side once.

    A pair that is the cheapest for both its sides is taken in any such pass, so rounds take all of those at once, until
    no pair is left. The cheapest of a side is an aggregate, so a side with very many pairs is met by partial results; the
    pairs taken are appended to one table, so the plan stays as long as it is. A pair without one of its sides is none.
    """
    spark, kinds = pairs.sparkSession, pairs.select(a, b, cost).schema
    taken = scratch(spark, "taken")
    spark.createDataFrame([], kinds).write.parquet(taken)
    steps = Steps(spark)
    left = steps.written(pairs.select(a, b, cost).where(F.col(a).isNotNull() & F.col(b).isNotNull()), "left")
    while not left.isEmpty():
        next_ = Steps(spark)
        cheapest = lambda side: left.groupBy(side).agg(F.min(F.struct(cost, a, b)).alias("m")).select("m")  # noqa: B023, E731
        won = next_.written(cheapest(a).join(cheapest(b), "m", "left_semi").select("m.*"), "won")
        won.select(a, b, cost).write.mode("append").parquet(taken)
        left = next_.written(left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti"), "left")
        steps.drop()
        steps = next_
    steps.drop()
    return spark.read.schema(kinds).parquet(taken)


def field_distance(x: Column, y: Column, tolerance: float, sx: Column, sy: Column) -> Column:
    """|x - y| in units of the tolerance and both spreads."""
    return F.abs(x - y) / F.sqrt(F.lit(tolerance * tolerance) + sx * sx + sy * sy)


def cluster_distance(fields: list[Column], veto: float = 3.0, shared: int = 3) -> Column:
    """RMS of the known field distances; null under ``shared`` known fields, infinite with any beyond the veto."""
    known = F.filter(F.array(*fields), lambda z: z.isNotNull())
    rms = F.sqrt(F.aggregate(known, F.lit(0.0), lambda a, z: a + z * z) / F.size(known))
    return F.when(F.size(known) < shared, None).when(F.exists(known, lambda z: z > veto), float("inf")).otherwise(rms)


def share_in(lo: Column, hi: Column, width: Column) -> Column:
    return clip((hi - lo) / width)
