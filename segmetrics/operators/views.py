"""Grid views of heatmap cells: metric selection, long form, colour range,
min-max scaling and the year x year grid.

A segment's cells lie in one array (``heatmap_graph``, the served shape), so
ranges and grids are computed inside the row and exploded last: no shuffle,
and a segment without cells keeps its rows.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.schema import (
    GRID_YEAR_MAX,
    GRID_YEAR_MIN,
    HEATMAP_METRIC_DEFAULT,
    HEATMAP_METRICS,
    KEY_COLUMNS,
)

CELLS = "heatmap_graph"


def metric_name(metric: str) -> str:
    """The metric, or the default for an unknown name."""
    return metric if metric in HEATMAP_METRICS else HEATMAP_METRIC_DEFAULT


def metric_value(cell: Column, metric: str) -> Column:
    return cell[metric_name(metric)].cast("double")


def _bounds(metric: str) -> Column:
    """(lo, hi) over a segment's non-null values, over all cells; no value ->
    lo 0; hi <= lo -> lo + 1."""
    values = F.filter(F.transform(CELLS, lambda c: metric_value(c, metric)), lambda v: v.isNotNull())
    lo = F.coalesce(F.array_min(values), F.lit(0.0))
    top = F.array_max(values)
    hi = F.when(top.isNull() | (top <= lo), lo + 1).otherwise(top)
    return F.struct(F.lit(metric).alias("metric"), lo.alias("min_value"), hi.alias("max_value"))


def metric_long(perf: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """One row per (cell, metric) for all six metrics."""
    cells = perf.select(*keys, F.explode(CELLS).alias("c"))
    args = ", ".join(f"'{m}', cast(c.`{m}` as double)" for m in HEATMAP_METRICS)
    return cells.select(*keys, "c.year_bought", "c.year_sold",
                        F.expr(f"stack({len(HEATMAP_METRICS)}, {args}) AS (metric, value)"))


def metric_range(perf: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Per (segment, metric): min_value and max_value."""
    return perf.select(*keys, F.inline(F.array(*[_bounds(m) for m in HEATMAP_METRICS])))


def metric_scaled(perf: DataFrame, keys: Sequence[str] = KEY_COLUMNS) -> DataFrame:
    """Min-max scaled value (0..1) of each cell within its segment and
    metric; null values stay null."""
    bounds = perf.select(*keys, CELLS, F.array(*[_bounds(m) for m in HEATMAP_METRICS]).alias("_bounds"))
    cells = bounds.select(*keys, "_bounds", F.explode(CELLS).alias("c"))
    args = ", ".join(f"_bounds[{i}], cast(c.`{m}` as double)" for i, m in enumerate(HEATMAP_METRICS))
    long = cells.select(*keys, "c.year_bought", "c.year_sold", F.expr(f"stack({len(HEATMAP_METRICS)}, {args}) AS (b, value)"))
    return long.select(*keys, "year_bought", "year_sold", "b.metric", "value", "b.min_value", "b.max_value").withColumn(
        "scaled", (F.col("value") - F.col("min_value")) / (F.col("max_value") - F.col("min_value")))


def grid_years(first: int = GRID_YEAR_MIN, last: int = GRID_YEAR_MAX) -> list[str]:
    return [str(y) for y in range(first, last + 1)]


def heatmap_grid(
    perf: DataFrame,
    metric: str = HEATMAP_METRIC_DEFAULT,
    years: Sequence[str] | None = None,
    keys: Sequence[str] = KEY_COLUMNS,
) -> DataFrame:
    """Rows: each segment x each year bought in ``years``; columns ``y<year>``
    for each year sold in ``years``; missing cells are null. A table loaded
    with two cells for one pair of years shows the first."""
    years = list(years or grid_years())
    bought = perf.select(*keys, CELLS, F.explode(F.array(*[F.lit(y) for y in years])).alias("year_bought"))
    row = bought.select(*keys, "year_bought", F.filter(CELLS, lambda c: c["year_bought"] == F.col("year_bought")).alias("_row"))

    def at(year: str) -> Column:
        cell = F.try_element_at(F.filter("_row", lambda c: c["year_sold"] == year), F.lit(1))
        return metric_value(cell, metric).alias(f"y{year}")

    return row.select(*keys, "year_bought", *[at(y) for y in years])
