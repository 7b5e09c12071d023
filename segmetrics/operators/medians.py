"""Exact lower medians of weighted values, group by group.

The lower median of a group is the value at which the running count, in the
order of the values (NaN last), reaches half of the group's count. No sketch
and no buffer of a group: a window walks the sorted values and spills.

A group of over ``GIANT_ROWS`` values would be one large window. The
``GIANT_GROUPS`` largest of them, few enough to broadcast, are sorted by
ranges instead: counts per range tell in which one the middle lies, and only
that range's values are walked.

The medians of a cube's groups (``cube_medians``) don't need the values of all
groups side by side: a histogram of each group, rolled up, tells in which
narrow bucket its middle lies, and only the values of that bucket are counted
and walked.
"""
from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.config import stored
from segmetrics.operators.cube import DIMS, expanded_sets, grouped_sets
from segmetrics.schema import LOCATION_LEVELS

GIANT_ROWS = 1_000_000
GIANT_GROUPS = 10_000


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys])


def _walked(rows: DataFrame, groups: Sequence[str], value: str, name: str, skipped: Column, total: Column) -> DataFrame:
    """The value at half of ``total``, ``skipped`` being counted before."""
    window = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    half = F.expr("(_total + 1) div 2")
    walked = rows.withColumns({"_upto": skipped + F.sum("_n").over(window), "_total": total})
    return walked.where((F.col("_upto") >= half) & (F.col("_upto") - F.col("_n") < half)).select(
        *groups, F.col(value).alias(name))


def exact_median(counts: DataFrame, groups: Sequence[str], value: str, name: str, n: str = "n",
                 giant_rows: int = GIANT_ROWS, before: str | None = None, total: str | None = None) -> DataFrame:
    """Distinct (``groups``, ``value``) with how often they occur (``n``) ->
    ``groups`` with the median, called ``name``. Nulls don't count; a group
    of nulls alone has no row. ``counts`` should be a stored table. It may
    hold the middle part of each group alone; ``before`` and ``total`` then
    name the counts of the values below that part, and of the whole group."""
    none = F.lit(0).cast("long")
    own = [(none if before is None else F.col(before)).alias("_before"), *([] if total is None else [F.col(total).alias("_total")])]
    rows = counts.where(F.col(value).isNotNull()).select(*groups, value, F.col(n).cast("long").alias("_n"), *own)
    whole_count = F.sum("_n") if total is None else F.max("_total")
    giant = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_rows"), whole_count.alias("_giant_total")).where(
        F.col("_rows") > giant_rows).orderBy(F.desc("_rows"), *groups).limit(GIANT_GROUPS).select(
        *[F.col(g).alias(f"_{g}") for g in groups], "_giant_total")
    whole = Window.partitionBy(*groups).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_of_it = F.sum("_n").over(whole) if total is None else F.col("_total")
    if giant.isEmpty():
        return _walked(rows, groups, value, name, F.col("_before"), all_of_it)
    giant = F.broadcast(stored(giant, "median-giant"))
    plain = _walked(rows.join(giant, _same(rows, giant, groups), "left_anti"), groups, value, name, F.col("_before"), all_of_it)
    # equal keys share a range, and (groups, value) are distinct
    large = rows.join(giant, _same(rows, giant, groups)).select(
        *groups, value, "_n", "_before", F.col("_giant_total").alias("_total"))
    ranged = stored(large.repartitionByRange(*groups, value).withColumn("_range", F.spark_partition_id()), "median-ranges")
    earlier = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = ranged.groupBy(*groups, "_range", "_total", "_before").agg(F.sum("_n").alias("_held"))
    skipped = held.withColumn("_skipped", F.col("_before") + F.coalesce(F.sum("_held").over(earlier), none))
    half = F.expr("(_total + 1) div 2")
    # one range of each giant group
    middle = F.broadcast(skipped.where((F.col("_skipped") < half) & (F.col("_skipped") + F.col("_held") >= half)).select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col("_range").alias("_at"), "_skipped"))
    near = ranged.join(middle, _same(ranged, middle, groups) & (ranged["_range"] == middle["_at"])).select(
        *ranged.columns, "_skipped")
    return plain.unionByName(_walked(near, groups, value, name, F.col("_skipped"), F.col("_total")))


def _bucket(value: Column) -> Column:
    """A number that grows with the value: 64 to each doubling on both sides
    of zero, and one each for the infinities and for NaN, which sorts last."""
    size = F.floor(F.log2(F.abs(value)) * 64).cast("int") + F.lit(1 << 17)
    far = F.lit(1 << 20)
    return (F.when(F.isnan(value), far + 1).when(value == float("inf"), far).when(value == float("-inf"), -far)
            .when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)))


def cube_medians(rows: DataFrame, by: Sequence[str], value: str, name: str, dims: Sequence[str] = DIMS, n: str | None = None) -> DataFrame:
    """Exact medians of the groups of ``grouped_sets(rows, ..., by, dims)``:
    its keys and ``name``; nulls don't count. ``rows``, a stored table, have
    ``by``, the location columns, ``dims``, ``value``, and may have a count."""
    finest = [*by, *[c for _, c in LOCATION_LEVELS], *dims]
    groups = [*by, "location_type", "location_value", *dims]
    weight = F.lit(1).cast("long") if n is None else F.col(n).cast("long")
    held = rows.where(F.col(value).isNotNull()).select(
        *finest, F.col(value).cast("double").alias(value), weight.alias("_n")).withColumn("_bucket", _bucket(F.col(value)))
    histogram = grouped_sets(held.groupBy(*finest, "_bucket").agg(F.sum("_n").alias("_n")), [F.sum("_n").alias("_n")], [*by, "_bucket"], dims)
    # at most as many rows in a window as there are buckets
    whole = Window.partitionBy(*groups)
    upto = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = histogram.withColumns({"_upto": F.sum("_n").over(upto), "_total": F.sum("_n").over(whole)})
    half = F.expr("(_total + 1) div 2")
    middle = stored(placed.where((F.col("_upto") >= half) & (F.col("_upto") - F.col("_n") < half)).select(
        *[F.col(g).alias(f"_{g}") for g in groups], F.col("_bucket").alias("_at"), (F.col("_upto") - F.col("_n")).alias("_before"), "_total"),
        "median-buckets")
    # buckets that no group wants leave before the rows are expanded
    wanted = middle.select(*[F.col(f"_{c}").alias(f"_wanted_{c}") for c in by], F.col("_at").alias("_wanted_at")).distinct()
    asked = reduce(lambda a, b: a & b, [held[c].eqNullSafe(wanted[f"_wanted_{c}"]) for c in by], held["_bucket"] == wanted["_wanted_at"])
    near = expanded_sets(held.join(wanted, asked, "left_semi"), dims)
    kept = near.join(middle, _same(near, middle, groups) & (near["_bucket"] == middle["_at"]))
    counts = stored(kept.groupBy(*groups, value, "_before", "_total").agg(F.sum("_n").alias("n")), "median-counts")
    return exact_median(counts, groups, value, name, before="_before", total="_total")


def with_cube_medians(cells: DataFrame, rows: DataFrame, by: Sequence[str], value: str, name: str, dims: Sequence[str] = DIMS) -> DataFrame:
    """``cells``, one row a group of the cube, with the group's exact median."""
    return _with(cells, cube_medians(rows, by, value, name, dims), [*by, "location_type", "location_value", *dims], name)


def _with(cells: DataFrame, medians: DataFrame, groups: Sequence[str], name: str) -> DataFrame:
    found = medians.select(*[F.col(g).alias(f"_{g}") for g in groups], name)
    return cells.join(found, _same(cells, found, groups), "left").select(*cells.columns, name)


def with_median(cells: DataFrame, counts: DataFrame, groups: Sequence[str], value: str, name: str) -> DataFrame:
    """``cells``, one row a group, with the group's exact median; null where
    the group has no value. Null keys are groups."""
    return _with(cells, exact_median(counts, groups, value, name), groups, name)
