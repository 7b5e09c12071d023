"""Metric sets, as lists of aliased aggregate Columns, for the cube.

Line path (all sales, per segment and year sold) and heatmap path (repeat
sales, per segment, year bought and year sold). Both paths reduce their rows
to mergeable states at the finest grain and roll these up. Medians can't be
rolled up: they are the exact lower medians of the cube's own groups
(``medians``); ``heatmap_metrics`` and ``price_stats_metrics`` have them as
``percentile_approx`` with accuracy 10000, the served contract's form.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmetrics.schema import MEDIAN_ACCURACY


def median(c: str) -> Column:
    return F.percentile_approx(F.col(c), 0.5, MEDIAN_ACCURACY)


def line_metrics(price: str = "price") -> list[Column]:
    """avg price and sale count; median and mode carry the mean (compat)."""
    avg = F.avg(price)
    return [
        avg.alias("avg_price"),
        avg.alias("median_price"),
        avg.alias("mode_price"),
        F.count(F.lit(1)).alias("sale_count"),
    ]


def heatmap_metrics() -> list[Column]:
    """Appreciation metrics of repeat sales."""
    n = F.count(F.lit(1))
    return [
        F.avg("appreciation_pounds").alias("avg_appreciation_pounds"),
        median("appreciation_pounds").alias("median_appreciation_pounds"),
        n.alias("sale_count"),
        F.avg("appreciation_pct").alias("avg_appreciation_pct"),
        median("appreciation_pct").alias("median_appreciation_pct"),
        (F.lit(100) * F.count_if(F.col("appreciation_pounds") > 0) / n).alias("pct_sales_appreciated"),
        F.min("appreciation_pounds").alias("biggest_loser_pounds"),
        F.min("appreciation_pct").alias("biggest_loser_pct"),
        F.max("appreciation_pounds").alias("biggest_winner_pounds"),
        F.max("appreciation_pct").alias("biggest_winner_pct"),
    ]


def price_stats_metrics() -> list[Column]:
    """Price view of repeat sales (avg/median/min/max sold price and the
    share sold at a loss)."""
    n = F.count(F.lit(1))
    return [
        F.avg("price").alias("avg_price"),
        median("price").alias("median_price"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        n.alias("sale_count"),
        (F.lit(100) * F.count_if(F.col("appreciation_pounds") < 0) / n).alias("pct_sales_at_loss"),
    ]


# Finest-grain partials for the line path: sum and count are mergeable, so
# the cube can roll up these partials instead of expanding every sale.
def line_partials(price: str = "price") -> list[Column]:
    return [F.sum(price).alias("_price_sum"), F.count(F.lit(1)).alias("_n")]


def line_metrics_from_partials() -> list[Column]:
    """``line_metrics`` over rows carrying ``_price_sum`` and ``_n``."""
    avg = F.sum("_price_sum") / F.sum("_n")
    return [
        avg.alias("avg_price"),
        avg.alias("median_price"),
        avg.alias("mode_price"),
        F.sum("_n").cast("bigint").alias("sale_count"),
    ]


# Finest-grain states of the heatmap path; ``_ap`` pounds, ``_pct`` percent.
def heatmap_partials() -> list[Column]:
    ap, pct = F.col("appreciation_pounds"), F.col("appreciation_pct")
    return [
        F.count(F.lit(1)).alias("_n"), F.count_if(ap > 0).alias("_up"),
        F.sum(ap).alias("_ap_sum"), F.min(ap).alias("_ap_min"), F.max(ap).alias("_ap_max"),
        F.sum(pct).alias("_pct_sum"), F.count(pct).alias("_pct_n"), F.min(pct).alias("_pct_min"), F.max(pct).alias("_pct_max"),
    ]


def merged_heatmap_partials() -> list[Column]:
    """The states of coarser groups, under the same names."""
    sums, least, most = ("_n", "_up", "_ap_sum", "_pct_sum", "_pct_n"), ("_ap_min", "_pct_min"), ("_ap_max", "_pct_max")
    return [*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most]]


def heatmap_metrics_from_partials() -> list[Column]:
    """``heatmap_metrics`` but the medians, from the states."""
    n = F.col("_n")
    return [
        (F.col("_ap_sum") / n).alias("avg_appreciation_pounds"),
        n.cast("bigint").alias("sale_count"),
        F.try_divide(F.col("_pct_sum"), F.col("_pct_n")).alias("avg_appreciation_pct"),
        (F.lit(100) * F.col("_up") / n).alias("pct_sales_appreciated"),
        F.col("_ap_min").alias("biggest_loser_pounds"), F.col("_pct_min").alias("biggest_loser_pct"),
        F.col("_ap_max").alias("biggest_winner_pounds"), F.col("_pct_max").alias("biggest_winner_pct"),
    ]


# Finest-grain states of the price view.
def price_stats_partials() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("appreciation_pounds") < 0).alias("_down"),
        F.sum("price").alias("_sum"), F.count("price").alias("_priced"), F.min("price").alias("_min"), F.max("price").alias("_max"),
    ]


def merged_price_stats_partials() -> list[Column]:
    return [*[F.sum(c).alias(c) for c in ("_n", "_down", "_sum", "_priced")], F.min("_min").alias("_min"), F.max("_max").alias("_max")]


def price_stats_from_partials() -> list[Column]:
    """``price_stats_metrics`` but the median, from the states."""
    return [
        F.try_divide(F.col("_sum"), F.col("_priced")).alias("avg_price"),
        F.col("_min").alias("min_price"), F.col("_max").alias("max_price"),
        F.col("_n").cast("bigint").alias("sale_count"),
        (F.lit(100) * F.col("_down") / F.col("_n")).alias("pct_sales_at_loss"),
    ]
