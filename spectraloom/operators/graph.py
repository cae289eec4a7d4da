"""Connected components of an edge table by alternating large-star and small-star steps.

Each round is two grouped minima joined back to the edges, so nothing but counters reaches the driver, and a node with very
many edges is met by partial aggregation. Every round is written to the shared folder, which cuts the lineage. The
rounds end when one changes no edge; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.sources.shared import drop_path, scratch


def _large_star(e: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the least of the node and its neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(e: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = e.groupBy("a").agg(F.min("b").alias("m"))
    moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the least node of its component, for every node that has an edge to another one.

    ``edges`` holds longs; order, repeats and loops don't matter, rows with nulls are left out.
    """
    spark = edges.sparkSession

    def store(e: DataFrame) -> tuple[str, DataFrame, tuple]:
        path = scratch(spark, "edges")
        e.distinct().write.parquet(path)
        kept = spark.read.schema("a long, b long").parquet(path)
        state = kept.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return path, kept, tuple(state)

    tidy = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    path, e, state = store(tidy)
    while state[0]:
        new_path, new, new_state = store(_small_star(_large_star(e)))
        drop_path(spark, path)
        path, e = new_path, new
        if new_state == state:
            break
        state = new_state
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def label_cells(cells: DataFrame, x: str, y: str, width: int) -> DataFrame:
    """x, y, label: 4-connected components of marked cells of a grid ``width`` columns of x wide, x from 0."""
    node = cells.select(x, y, (F.col(y) * width + F.col(x)).alias("node"))
    right = node.select((F.col("node") + 1).alias("node"), F.col("node").alias("a"), F.col(x).alias("x_"))
    up = node.select((F.col("node") + width).alias("node"), F.col("node").alias("a"))
    edges = node.join(right.where(F.col("x_") < width - 1), "node").select("a", F.col("node").alias("b")).unionByName(node.join(up, "node").select("a", F.col("node").alias("b")))
    roots = connected_components(edges)
    return node.join(roots, "node", "left").select(x, y, F.coalesce("root", "node").alias("label"))
