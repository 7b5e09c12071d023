"""Dimension joins: broadcast within the size bound, shuffle beyond it."""
from segmetrics.operators.joins import estimated_bytes, join_dimension


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_broadcast_within_bound(spark):
    dim, fact = spark.range(100).withColumnRenamed("id", "k"), spark.range(1000).withColumnRenamed("id", "k")
    size = estimated_bytes(dim)
    assert size == 800
    small = join_dimension(fact, dim, "k", max_bytes=size)
    assert "BroadcastHashJoin" in plan_of(small) and small.count() == 100
    large = join_dimension(fact, dim, "k", max_bytes=size - 1)
    assert "BroadcastHashJoin" not in plan_of(large) and "SortMergeJoin" in plan_of(large)
    assert large.count() == 100
