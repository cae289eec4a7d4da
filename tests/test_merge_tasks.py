"""Merging keeps its tasks: intervals that are few bytes in a shuffle don't all land in one task's sort."""

from spectraloom.operators.intervals import gaps, merge


def test_merge_and_gaps_keep_their_tasks(spark):
    visits = spark.range(6000).selectExpr("id % 300 as k", "id div 300 * 100 as lo", "id div 300 * 100 + 60 as hi")
    islands = merge(visits, ["k"], "lo", "hi", 500)
    assert islands.count() == 6000
    assert islands.rdd.getNumPartitions() >= 32
    found = gaps(islands, ["k"], "lo", "hi", 0, 3000, least=40, asked=visits)
    assert found.count() == 300 * 20  # 19 gaps of 40 between, and the end
