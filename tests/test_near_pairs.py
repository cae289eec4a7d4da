"""Correlated events meet only where they may score: by band of cells and longitude, none lost."""

import random

from pyspark.sql import functions as F

from spectraloom.functions.scalar import great_circle_km
from spectraloom.operators.joins import longitude_cells, time_bucket_pairs


def test_longitude_cells_hold_all_places_within_reach(spark):
    rng = random.Random(5)
    place = lambda: (float(rng.choice([rng.randrange(-100, 100), rng.randrange(-50, 50), 89, -90])), float(rng.choice([rng.randrange(-180, 180), -180, 179])))
    rows = [(*place(), *place()) for _ in range(20000)]
    rows += [(a, o, a + rng.randrange(-7, 8), (o + 180 + rng.randrange(-40, 41)) % 360 - 180) for a, o, _, _ in rows]
    pairs = spark.createDataFrame(rows, "al double, ao double, bl double, bo double").where("abs(al - bl) <= 7")
    near = pairs.where(great_circle_km(*map(F.col, ("al", "ao", "bl", "bo"))) <= 2334)
    held = near.withColumn("cells", longitude_cells(F.col("al"), F.col("ao"), 2334.0, 7.0, 20))
    met = F.array_contains("cells", F.floor((F.col("bo") + 180) / 20))
    r = held.agg(F.count("*").alias("n"), F.count_if(met).alias("met"), F.count_if(F.size("cells") < 9).alias("few"), F.max(F.size("cells")).alias("most")).first()
    assert r.n == r.met > 5000 and r.few > 3000 and r.most == 18


def test_pairs_keep_their_tasks(spark):
    few = spark.range(500).selectExpr("id as t", "id % 3 as k")
    other = few.selectExpr("t as u", "k as l")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = time_bucket_pairs(few, other, [("k", "l")], "t", "u", 10)
        assert pairs.count() == sum(abs(t - u) <= 10 and (t - u) % 3 == 0 for t in range(500) for u in range(500))
        assert pairs.rdd.getNumPartitions() >= 32
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
