"""Build job: raw sales -> clean sales -> line and heatmap cubes -> the
performance table (one row per segment) and the dimension index.

Shuffles on the sales: those of the repeat-sale pairing, and one
partial-aggregated exchange per cube. Series assembly and
the line/heatmap join run on aggregated rows.
"""
from __future__ import annotations

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
)
from segmetrics.operators.clean import clean_sales
from segmetrics.operators.cube import DIMS, copied_to_types, grouped_sets, segment_cube_gs
from segmetrics.operators.medians import with_cube_medians
from segmetrics.operators.repeat import repeat_sales
from segmetrics.operators.series import performance_from_aggs
from segmetrics.operators.upsert import DIMENSION_KEYS
from segmetrics.schema import HEATMAP_CELL, KEY_COLUMNS
from segmetrics.sources.buckets import BUCKETS, write_version

LINE_BASE = ["price", "year_sold", "county", "outcode", "district"]
HEAT_BASE = ["appreciation_pounds", "appreciation_pct", "year_bought", "year_sold", "county", "outcode", "district"]
HEAT_METRICS = [f.name for f in HEATMAP_CELL.fields if f.name not in ("year_bought", "year_sold")]
LINE_INPUT = [*LINE_BASE, *DIMS]
HEAT_INPUT = [*HEAT_BASE, *DIMS]


def line_agg(sales: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Line path: (segment, year_sold) -> avg price, count.

    Sales are first reduced to partials (sum, count) by location, ``dims``
    and year; the grouping sets then expand those partials, not every sale."""
    finest = [*[c for c in LINE_BASE if c != "price"], *dims]
    partials = sales.groupBy(*finest).agg(*line_partials())
    return segment_cube_gs(partials, line_metrics_from_partials(), by=["year_sold"], dims=dims)


def heatmap_agg(repeats: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Heatmap path: (segment, year_bought, year_sold) -> appreciation metrics.

    Repeat sales are reduced to mergeable states by location, ``dims`` and
    years, and the grouping sets expand those. Only the medians need the
    values: those of the bucket in which a group's middle lies."""
    by, values = ["year_bought", "year_sold"], ["appreciation_pounds", "appreciation_pct"]
    finest = [c for c in HEAT_BASE if c not in values] + list(dims)
    rows = stored(repeats.select(*HEAT_BASE, *dims), "repeats")
    groups = [*by, "location_type", "location_value", *dims]
    cells = grouped_sets(rows.groupBy(*finest).agg(*heatmap_partials()), merged_heatmap_partials(), by, dims).select(
        *groups, *heatmap_metrics_from_partials())
    for value in values:
        cells = with_cube_medians(cells, rows, by, value, f"median_{value}", dims)
    return copied_to_types(cells.select(*groups, *HEAT_METRICS), by)


def shared_sales(sales: DataFrame) -> DataFrame:
    """Clean sales written once as Parquet into the cluster's shared folder.

    The line path, the heatmap path and both branches of the repeat-sale
    pairing read this copy: the raw input is scanned and cleaned once, a lost
    executor re-reads the files, and each path reads only its columns."""
    return stored(sales, "sales")


def performance_from_sales(sales: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    return performance_from_shared(shared_sales(sales), dims)


def performance_from_shared(shared: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Performance table from sales already prepared by ``shared_sales``."""
    return performance_from_aggs(line_agg(shared, dims), heatmap_agg(repeat_sales(shared), dims))


def performance_from_raw(
    raw: DataFrame, predicate: Column | None = None, require_address: bool = False
) -> DataFrame:
    return performance_from_sales(clean_sales(raw, predicate, require_address))


def build_serving_tables(sales: DataFrame, base_path: str, dims: Sequence[str] = DIMS,
                         buckets: int = BUCKETS) -> dict[str, str]:
    """Write the performance table and the dimension index as the next
    versions of two bucketed tables. The index is derived from the *written*
    table, reading only its key columns and counts, so the cube is never
    computed twice."""
    from segmetrics.operators.dimensions import dimension_index

    spark = sales.sparkSession
    perf_path = f"{base_path}/performance"
    dim_path = f"{base_path}/dimension_index"
    perf = write_version(performance_from_sales(sales, dims), perf_path, KEY_COLUMNS, buckets)
    written = perf.read(spark).select(*KEY_COLUMNS, "sale_count")
    write_version(dimension_index(written), dim_path, DIMENSION_KEYS, 1)
    return {"performance": perf_path, "dimension_index": dim_path}
