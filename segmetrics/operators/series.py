"""Per-segment series: ordered arrays of structs, and the performance table.

A segment holds at most (#years) line points and (#years^2) heatmap cells,
so ``collect_list`` runs on already-aggregated rows only.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.schema import HEATMAP_CELL, KEY_COLUMNS, LINE_POINT


def line_series(line_agg: DataFrame) -> DataFrame:
    """(key, year_sold, metrics) -> (key, line_graph sorted by year, sale_count)."""
    point = F.struct(
        F.col("year_sold").cast("string").alias("year_sold"),
        F.col("avg_price").cast("double").alias("avg_price"),
        F.col("median_price").cast("double").alias("median_price"),
        F.col("mode_price").cast("double").alias("mode_price"),
        F.col("sale_count").cast("bigint").alias("sale_count"),
    )
    return line_agg.groupBy(*KEY_COLUMNS).agg(
        F.sort_array(F.collect_list(point)).alias("line_graph"),
        F.sum("sale_count").cast("bigint").alias("sale_count"),
    )


def heatmap_series(heat_agg: DataFrame) -> DataFrame:
    """(key, year_bought, year_sold, metrics) -> (key, heatmap_graph sorted by
    (year_bought, year_sold))."""
    fields = []
    for f in HEATMAP_CELL.fields:
        src = f.name
        fields.append(F.col(src).cast(f.dataType.simpleString()).alias(f.name))
    return heat_agg.groupBy(*KEY_COLUMNS).agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("heatmap_graph")
    )


def performance_table(lines: DataFrame, heatmaps: DataFrame) -> DataFrame:
    """Left join line series with heatmap series on the key; a segment with
    no repeat sale gets an empty heatmap."""
    empty = F.array().cast(f"array<{HEATMAP_CELL.simpleString()}>")
    joined = lines.join(heatmaps, KEY_COLUMNS, "left")
    return joined.select(
        *KEY_COLUMNS,
        F.col("line_graph").cast(f"array<{LINE_POINT.simpleString()}>").alias("line_graph"),
        F.coalesce(F.col("heatmap_graph"), empty).alias("heatmap_graph"),
        F.col("sale_count"),
    )


def performance_from_aggs(line_agg: DataFrame, heat_agg: DataFrame) -> DataFrame:
    """Same rows as ``performance_table(line_series(line_agg),
    heatmap_series(heat_agg))`` in a single aggregation: line points and
    heatmap cells are unioned and gathered per key with two
    ``collect_list``s, so one shuffle replaces two series aggregations plus
    a join. Keys come from the line side, as in the left join."""
    point_t = LINE_POINT.simpleString()
    cell_t = HEATMAP_CELL.simpleString()
    point = F.struct(
        F.col("year_sold").cast("string").alias("year_sold"),
        F.col("avg_price").cast("double").alias("avg_price"),
        F.col("median_price").cast("double").alias("median_price"),
        F.col("mode_price").cast("double").alias("mode_price"),
        F.col("sale_count").cast("bigint").alias("sale_count"),
    )
    cell = F.struct(*[F.col(f.name).cast(f.dataType.simpleString()).alias(f.name) for f in HEATMAP_CELL.fields])
    lines = line_agg.select(*KEY_COLUMNS, point.alias("_p"), F.lit(None).cast(cell_t).alias("_c"))
    cells = heat_agg.select(*KEY_COLUMNS, F.lit(None).cast(point_t).alias("_p"), cell.alias("_c"))
    gathered = lines.unionByName(cells).groupBy(*KEY_COLUMNS).agg(
        F.sort_array(F.collect_list("_p")).alias("line_graph"),
        F.sort_array(F.collect_list("_c")).alias("heatmap_graph"),
        F.sum("_p.sale_count").cast("bigint").alias("sale_count"),
    )
    return gathered.where(F.size("line_graph") > 0).select(
        *KEY_COLUMNS, "line_graph", "heatmap_graph", "sale_count"
    )
