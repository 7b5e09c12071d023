"""Merging several series into one (count-weighted), per group.

``items`` has a group column and one series array per row; the result has one
row per (group, year) or (group, year bought, year sold). A group of one item
passes its values through unchanged.

Line: weighted mean of avg/median/mode by sale_count, counts summed; when
the counts sum to 0, the plain mean.
Heatmap: as line for the pounds metrics and the appreciated share; percent
metrics skip null values in both numerator and weight (all null -> null);
with a zero total count, nulls count as 0 in a plain mean.

Series are exploded first and combined map-side per (group, year); the number
of items of a group, which tells a single item from a point that only one
of several items has, is a narrow count joined to the merged rows. Where the
caller marks the items that are their group's only one (``alone``), these
are exploded and passed through without an aggregation.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE_VALUES = ["avg_price", "median_price", "mode_price"]
HEAT_POUNDS = ["avg_appreciation_pounds", "median_appreciation_pounds", "pct_sales_appreciated"]
HEAT_PCT = ["avg_appreciation_pct", "median_appreciation_pct"]
HEAT_OUT = ["avg_appreciation_pounds", "median_appreciation_pounds", "sale_count",
            "avg_appreciation_pct", "median_appreciation_pct", "pct_sales_appreciated"]


def _merge(items: DataFrame, group: str, series: str, by: Sequence[str], values: dict[str, list[Column]],
           choose, alone: str | None = None) -> DataFrame:
    """Partial sums per (group, by), joined with the group's item count."""
    if alone is not None:
        # an item with two points for the same years is merged with itself
        years = F.transform(series, lambda p: F.struct(*[p[b] for b in by]))
        passes = F.coalesce(F.col(alone) & (F.size(F.array_distinct(years)) == F.size(series)), F.lit(False))
        merged = _merge(items.where(~passes), group, series, by, values, choose)
        through = items.where(passes).select(group, F.explode(series).alias("p")).select(
            group, *[F.col(f"p.{c}") for c in by], F.col("p.sale_count").cast("bigint").alias("sale_count"), *[F.col(f"p.{v}") for v in values])
        return merged.unionByName(through)
    points = items.select(group, F.explode(series).alias("p")).select(group, "p.*")
    n = F.col("sale_count")
    sums = [F.sum(n).cast("bigint").alias("sale_count")]
    for v, parts in values.items():
        sums += [F.max(v).alias(f"_one_{v}"), *parts]
    merged = points.groupBy(group, *by).agg(*sums)
    count = items.groupBy(F.col(group).alias("_group")).agg((F.count(F.lit(1)) == 1).alias("_single"))
    both = merged.join(count, F.col(group).eqNullSafe(F.col("_group")))
    out = {v: F.when(F.col("_single"), F.col(f"_one_{v}")).otherwise(choose(v)).alias(v) for v in values}
    return both.select(group, *by, "sale_count", *out.values())


def _weighted(v: str) -> list[Column]:
    n = F.col("sale_count")
    has = F.col(v).isNotNull()
    return [F.sum(F.when(has, F.col(v) * n)).alias(f"_sum_{v}"), F.sum(F.when(has, n)).alias(f"_weight_{v}")]


def merge_line(items: DataFrame, group: str, series: str = "line_graph", alone: str | None = None) -> DataFrame:
    values = {v: [*_weighted(v), F.avg(v).alias(f"_plain_{v}")] for v in LINE_VALUES}

    def choose(v: str) -> Column:
        return F.when(F.col("sale_count") == 0, F.col(f"_plain_{v}")).otherwise(
            F.try_divide(F.col(f"_sum_{v}"), F.col("sale_count")))

    return _merge(items, group, series, ["year_sold"], values, choose, alone).select(
        group, "year_sold", *LINE_VALUES, "sale_count")


def merge_heatmap(items: DataFrame, group: str, series: str = "heatmap_graph", alone: str | None = None) -> DataFrame:
    values = {v: [*_weighted(v), F.avg(F.coalesce(F.col(v), F.lit(0.0))).alias(f"_plain_{v}")]
              for v in [*HEAT_POUNDS, *HEAT_PCT]}

    def choose(v: str) -> Column:
        weight = f"_weight_{v}" if v in HEAT_PCT else "sale_count"
        return F.when(F.col("sale_count") == 0, F.col(f"_plain_{v}")).otherwise(
            F.try_divide(F.col(f"_sum_{v}"), F.col(weight)))

    return _merge(items, group, series, ["year_bought", "year_sold"], values, choose, alone).select(
        group, "year_bought", "year_sold", *HEAT_OUT)


def to_line_series(merged: DataFrame, group: str) -> DataFrame:
    """Long merged points -> one ordered array per group."""
    point = F.struct("year_sold", *LINE_VALUES, "sale_count")
    return merged.groupBy(group).agg(F.sort_array(F.collect_list(point)).alias("series"))
