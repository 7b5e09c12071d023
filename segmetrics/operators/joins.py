"""Fact-to-dimension joins.

A dimension is broadcast only if the optimizer's size of it is within
``MAX_BROADCAST_BYTES``; the check reads statistics, not data. Beyond that
the join shuffles both sides, and Spark splits skewed keys. The fact side is
never broadcast: a small compressed file can hold a large table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 8 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan; runs no job. None where the
    session doesn't give it, as a remote one."""
    plan = getattr(df, "_jdf", None)
    return None if plan is None else int(str(plan.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_dimension(fact: DataFrame, dim: DataFrame, on: Column | str | list, how: str = "inner",
                   max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    size = estimated_bytes(dim)
    if size is not None and size <= max_bytes:
        return fact.join(F.broadcast(dim), on, how)
    return fact.hint("merge").join(dim.hint("merge"), on, how)
