"""Declared extras: exact mode and median, price statistics, street-level
aggregates, size and year bands."""
from __future__ import annotations

from itertools import product
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.config import stored
from segmetrics.operators.aggregates import (
    heatmap_metrics_from_partials,
    heatmap_partials,
    line_metrics_from_partials,
    line_partials,
    merged_heatmap_partials,
    merged_price_stats_partials,
    price_stats_from_partials,
    price_stats_partials,
)
from segmetrics.operators.cube import DIMS, copied_to_types, expanded_sets, grouped_sets
from segmetrics.operators.medians import cube_medians, with_cube_medians, with_median
from segmetrics.schema import ALL, HEATMAP_CELL, KEY_COLUMNS, LOCATION_LEVELS

SEGMENT_YEAR = [*KEY_COLUMNS, "year_sold"]


# (location, year, price) counts that one task expands
PART_ROWS = 100_000


def finest_price_counts(sales: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(locations, dimensions, year sold, price) -> n, stored."""
    finest = [c for _, c in LOCATION_LEVELS]
    return stored(sales.groupBy(*finest, *dims, "year_sold", "price").agg(F.count(F.lit(1)).alias("n")), "finest-price-counts")


def line_mode(finest: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Most frequent price per (segment, year sold), the lowest on ties, and
    the count of sales, from ``finest_price_counts``.

    All counts of a year and price lie in one partition, so those of every
    segment are added up there, in partitions of bounded size, and only the
    best price of each segment in each of them moves."""
    parts = max(finest.sparkSession.sparkContext.defaultParallelism, -(-finest.count() // PART_ROWS))
    groups = ["year_sold", "location_type", "location_value", *dims]
    dealt = expanded_sets(finest.repartition(parts, "year_sold", "price"), dims)
    counts = dealt.groupBy(*groups, "price").agg(F.sum("n").alias("n"))
    modes = counts.groupBy(*groups).agg(
        F.max_by("price", F.struct(F.col("n"), -F.col("price"))).alias("mode_price"), F.sum("n").cast("bigint").alias("sale_count"))
    return copied_to_types(modes, ["year_sold"])


def line_true_stats(finest: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Exact lower median and mode per (segment, year sold), from
    ``finest_price_counts``."""
    medians = copied_to_types(cube_medians(finest, ["year_sold"], "price", "median_price", dims, n="n"), ["year_sold"])
    return medians.join(line_mode(finest, dims), SEGMENT_YEAR)


def price_stats_cube(repeats: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Price view of repeat sales by (segment, year bought, year sold). The
    cube expands states of the finest grain, and for the exact medians the
    prices of the buckets in which they lie, not every sale."""
    by = ["year_bought", "year_sold"]
    finest = [*by, *[c for _, c in LOCATION_LEVELS], *dims]
    groups = [*by, "location_type", "location_value", *dims]
    rows = stored(repeats.select(*finest, "price", "appreciation_pounds"), "price-stats")
    cells = grouped_sets(rows.groupBy(*finest).agg(*price_stats_partials()), merged_price_stats_partials(), by, dims).select(
        *groups, *price_stats_from_partials())
    return copied_to_types(with_cube_medians(cells, rows, by, "price", "median_price", dims), by)


def street_line(sales: DataFrame) -> DataFrame:
    """Line metrics per (street, year sold); ``sales`` carry a street."""
    return sales.groupBy("street", "year_sold").agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("sale_count"))


def street_heatmap(repeats: DataFrame) -> DataFrame:
    """Appreciation metrics per (street, year bought, year sold); medians
    exact, from the values' counts."""
    groups, values = ["street", "year_bought", "year_sold"], ["appreciation_pounds", "appreciation_pct"]
    rows = stored(repeats.select(*groups, *values), "street-repeats")
    cells = rows.groupBy(*groups).agg(*heatmap_partials()).select(*groups, *heatmap_metrics_from_partials())
    for value in values:
        counts = stored(rows.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n")), "street-counts")
        cells = with_median(cells, counts, groups, value, f"median_{value}")
    return cells.select(*groups, *[f.name for f in HEATMAP_CELL.fields if f.name not in groups])


def street_cube(sales: DataFrame, least: int, dims: Sequence[str] = DIMS) -> DataFrame:
    """Line metrics of streets as a fourth location type: (segment, year
    sold) for each street of at least ``least`` sales. Iceberg: streets below
    leave by their counts, before the dimensions are expanded."""
    counts = sales.groupBy(F.col("street").alias("_street")).agg(F.count(F.lit(1)).alias("_sales"))
    large = counts.where(F.col("_sales") >= least).select("_street")
    finest = ["street", *dims, "year_sold"]
    partials = sales.join(large, F.col("street") == F.col("_street"), "left_semi").groupBy(*finest).agg(*line_partials())
    sets = [["street", "year_sold", *[d for d, keep in zip(dims, mask) if keep]] for mask in product([True, False], repeat=len(dims))]
    flags = [F.grouping(d).alias(f"_g_{d}") for d in dims]
    cube = partials.groupingSets(sets, *finest).agg(*line_metrics_from_partials(), *flags)
    values = {"location_type": F.lit("street"), "location_value": F.col("street"), **{
        d: F.when(F.col(f"_g_{d}") == 1, F.lit(ALL)).otherwise(F.col(d)) for d in dims}}
    return cube.select(*[values.get(k, F.lit(ALL)).alias(k) for k in KEY_COLUMNS], "year_sold",
                       "avg_price", "median_price", "mode_price", "sale_count")


def year_band(year: Column, width: int = 5) -> Column:
    """'1995-1999', '2000-2004', ... of a year; 'unknown' if it is null."""
    low = (F.floor(year / width) * width).cast("int")
    return F.when(year.isNotNull(), F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))).otherwise("unknown")


def bought_band_cube(repeats: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Appreciation by segment, band of the year bought, and year sold, from
    the mergeable states of the heatmap path."""
    by = ["year_bought_band", "year_sold"]
    locations = [c for _, c in LOCATION_LEVELS]
    rows = repeats.withColumn("year_bought_band", year_band(F.col("year_bought")))
    states = rows.groupBy(*by, *locations, *dims).agg(*heatmap_partials())
    cells = grouped_sets(states, merged_heatmap_partials(), by, dims)
    return copied_to_types(cells.select(*[c for c in cells.columns if not c.startswith("_")], *heatmap_metrics_from_partials()), by)


def size_band(size: Column, width: int = 10) -> Column:
    """'1-10', '11-20', ... of a size in whole units; 'unknown' if it is null
    or under 1."""
    low = F.floor((size - 1) / width) * width + 1
    return F.when(size >= 1, F.concat(low.cast("string"), F.lit("-"), (low + width - 1).cast("string"))).otherwise("unknown")
