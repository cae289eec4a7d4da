"""Tiles that merge in any order, folds that carry or lose histograms, and streams with rows later than their tiles' seal."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spectraloom.operators import tiles as T
from spectraloom.streaming.tiles import drained_tiles

BINS = T.Bins(0.0, 0.5, 60)
S = 1_000_000
SHAPE = "f long, at_us long, db double, s double"


def cells(df):
    return T.partial_cells(df, F.col("f"), F.floor(F.col("at_us") / (60 * S)), "db", F.col("s"), F.col("db") >= 10, BINS)


def rows(n, rng):
    return [(rng.randrange(5), rng.randrange(1, 3600) * S, rng.choice([rng.uniform(-5, 40), 3.25]), rng.choice([0.5, 2.0])) for _ in range(n)]


def plain(cell):
    return {k: round(v, 6) if isinstance(v, float) else dict(v) if isinstance(v, dict) else v for k, v in cell.items()}


def by_cell(df):
    return {(r["f"], r["t"]): plain({c: r[c] for c in ("n", "max_db", "power", "cover_s", "occupied_s", "hist")}) for r in df.collect()}


def test_partial_cells_merge_in_any_order(spark):
    data = rows(600, random.Random(1)) + [(9, 5 * S, None, 1.0), (9, 6 * S, float("nan"), 1.0)]
    whole = by_cell(cells(spark.createDataFrame(data, SHAPE)))
    parts = [cells(spark.createDataFrame(data[k::4], SHAPE)) for k in range(4)]
    merged = T.merge_cells(T.merge_cells(parts[2].unionByName(parts[0])).unionByName(parts[3]).unionByName(parts[1]))
    assert by_cell(merged).keys() == whole.keys()
    for k, v in by_cell(merged).items():
        assert v["n"] == whole[k]["n"] and v["hist"] == whole[k]["hist"] and v["cover_s"] == whole[k]["cover_s"]
    assert whole[9, 0]["hist"] == {0: 2}


@pytest.mark.parametrize("q", [0, 10, 50, 90, 100])
def test_percentiles_are_one_step_off_at_most(spark, q):
    data = [(0, S, x, 1.0) for x in np.random.default_rng(q).uniform(0, 29.9, 200)]
    got = cells(spark.createDataFrame([(f, a, float(x), s) for f, a, x, s in data], SHAPE)).select(T.hist_percentile(F.col("hist"), q, BINS).alias("p")).first().p
    assert abs(got - np.percentile([x for _, _, x, _ in data], q)) <= 0.5 + 0.2
    empty = spark.createDataFrame([({},)], "hist map<int,bigint>").select(T.hist_percentile(F.col("hist"), q, BINS).alias("p")).first().p
    assert empty is None


def test_histograms_survive_whole_tiles_only(spark):
    level = T.with_shares(cells(spark.createDataFrame(rows(500, random.Random(2)), SHAPE)))
    full, part = T.fold_tiles(level, 5, 12, 6), T.fold_tiles(level, 5, 4, 6)
    assert {sum(r.hist.values()) == r.n for r in full.collect()} == {True} and {r.hist for r in part.collect()} == {None}
    assert {r.hist for r in T.fold_tiles(part, 1, 6, 6).collect()} == {None}  # what is lost stays lost
    assert full.agg(F.sum("n")).first()[0] == 500


def test_stream_with_late_rows_equals_batch(spark, tmp_path):
    """Files in a bad order: many rows come after their tile's seal, and all count, occupancy and percentiles too."""
    data = sorted(rows(800, random.Random(3)), key=lambda r: r[1])
    order = [*range(0, 600), *range(700, 800), *range(600, 700)]
    random.Random(4).shuffle(order[:300])
    parts = [[data[i] for i in order[k : k + 100]] for k in range(0, 800, 100)]
    parts.append([(0, 30 * S, 39.0, 2.0), (7, 45 * S, 12.0, 1.0)])  # an old tile, and one that nobody had seen
    for part in parts:
        spark.createDataFrame(part, SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    store = drained_tiles(stream, cells, "at_us", 60 * S, 120 * S)
    want = by_cell(cells(batch))
    assert by_cell(store.tiles()) == want
    told = {(r["f"], r["t"]): r for r in store.tiles().collect()}
    newest = max(r[1] for part in parts for r in part)
    assert all(r["sealed"] == ((t + 1) * 60 * S <= newest - 120 * S) for (_, t), r in told.items())
    assert told[7, 0]["n_late"] == 1 and told[7, 0]["revision"] == 1 and told[0, 0]["n_late"] >= 1
    assert sum(r["n_late"] for r in told.values()) > 50
    store.add(spark.createDataFrame(parts[-1], SHAPE), len(parts) - 1)  # run again after a failure
    assert by_cell(store.tiles()) == want
    store.compact()
    assert by_cell(store.tiles()) == want and {k: r["n_late"] for k, r in told.items()} == {(r["f"], r["t"]): r["n_late"] for r in store.tiles().collect()}
