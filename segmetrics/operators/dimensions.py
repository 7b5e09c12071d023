"""Dimension index: the distinct values of every dimension, from the
segment keys of the performance table, with labels and sale counts.

One ``stack`` over the key columns replaces a union of per-dimension
selects; the distinct step is an aggregation (map-side combined), so the
``all`` value, present in most keys, never reaches one task unreduced.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.functions.labels import dimension_label
from segmetrics.schema import ALL, KEY_COLUMNS

# (dimension, value expression) in index order
_PAIRS = [
    ("county", "if(location_type = 'county', location_value, null)"),
    ("postcode", "if(location_type = 'postcode', location_value, null)"),
    ("borough", "if(location_type = 'borough', location_value, null)"),
    ("house_type", "house_type"),
    ("tenure", "tenure"),
    ("size_band", "size_band"),
    ("year_built_band", "year_built_band"),
]
_OWN = {
    "county": "location_value",
    "postcode": "location_value",
    "borough": "location_value",
    "house_type": "house_type",
    "tenure": "tenure",
    "size_band": "size_band",
    "year_built_band": "year_built_band",
}
_PARTS = ["location_value", "house_type", "tenure", "size_band", "year_built_band"]


def _others_all() -> F.Column:
    """True when every key part except the row's own dimension is 'all'."""
    cond = None
    for dim, own in _OWN.items():
        rest = [F.col(p) == F.lit(ALL) for p in _PARTS if p != own]
        all_rest = rest[0]
        for r in rest[1:]:
            all_rest = all_rest & r
        term = (F.col("dimension_name") == dim) & all_rest
        cond = term if cond is None else cond | term
    return cond


def dimension_index(perf: DataFrame) -> DataFrame:
    """(dimension_name, value, label, sale_count). ``sale_count`` is the
    count of the segment where only this dimension is set (the others 'all')."""
    args = ", ".join(f"'{d}', {e}" for d, e in _PAIRS)
    stacked = perf.select(
        *KEY_COLUMNS,
        "sale_count",
        F.expr(f"stack({len(_PAIRS)}, {args}) AS (dimension_name, value)"),
    ).where(F.col("value").isNotNull())
    distinct = stacked.groupBy("dimension_name", "value").agg(
        F.max(F.when(_others_all(), F.col("sale_count"))).cast("bigint").alias("sale_count")
    )
    return distinct.select(
        "dimension_name",
        "value",
        dimension_label(F.col("dimension_name"), F.col("value")).alias("label"),
        "sale_count",
    )


def list_dimension(index: DataFrame, dimension_name: str) -> DataFrame:
    """Values of one dimension in value order (the full list, no paging)."""
    return (
        index.where(F.col("dimension_name") == F.lit(dimension_name))
        .select("dimension_name", "value", "label", "sale_count")
        .orderBy("value")
    )
