"""The segment cube: every sale counts toward 3 location types x 8
value-or-'all' masks = 24 segments.

* ``location_fanout``  one row per location type (``stack``, one scan).
* ``segment_cube``     fan-out, then ``CUBE`` of (location value, house type,
  tenure) per location type: 3 x 8 grouping sets over 3x the rows.
* ``segment_cube_gs``  the same result from 16 grouping sets over the sales
  themselves: {county}, {outcode}, {district}, {} x CUBE(house type, tenure).
  The {} sets are identical for every location type, so they are computed
  once and copied to the three types after aggregation.
* ``affected_keys``    the keys a given segment row contributes to.

The dimensions next to the location are a parameter: with the size band as
a third, a sale counts toward 48 segments.

Aggregates are passed in as aliased Columns; the grouping is the
``Expand`` + partial/final ``HashAggregate`` Catalyst plans for grouping sets,
so mergeable metrics are pre-aggregated map-side and a hot segment (the
``all`` roll-ups receive every sale) never sends raw rows to one task.
"""
from __future__ import annotations

from itertools import product
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.schema import ALL, KEY_COLUMNS, LOCATION_LEVELS

DIMS = ("house_type", "tenure")


def location_fanout(df: DataFrame) -> DataFrame:
    """One row per (sale, location type) with its ``location_value``."""
    args = ", ".join(f"'{t}', `{c}`" for t, c in LOCATION_LEVELS)
    fan = F.expr(f"stack({len(LOCATION_LEVELS)}, {args}) AS (location_type, location_value)")
    loc_cols = {c for _, c in LOCATION_LEVELS}
    keep = [c for c in df.columns if c not in loc_cols]
    return df.select(*keep, fan)


def _key_select(value_exprs: dict[str, Column], by: Sequence[str], metrics: Sequence[str]) -> list[Column]:
    cols = [value_exprs[k].alias(k) for k in KEY_COLUMNS]
    return cols + [F.col(c) for c in by] + [F.col(m) for m in metrics]


def segment_cube(
    df: DataFrame,
    aggs: Sequence[Column],
    by: Sequence[str] = (),
    dims: Sequence[str] = DIMS,
) -> DataFrame:
    """Fan-out + CUBE form. Output: 6 key columns, ``by`` columns, metrics."""
    fan = location_fanout(df)
    cube_cols = ["location_value", *dims]
    fixed = ["location_type", *by]
    sets = [
        [*fixed, *[c for c, keep in zip(cube_cols, mask) if keep]]
        for mask in product([True, False], repeat=len(cube_cols))
    ]
    flags = [F.grouping(c).alias(f"_g_{c}") for c in cube_cols]
    agg = fan.groupingSets(sets, *fixed, *cube_cols).agg(*aggs, *flags)
    metrics = [c for c in agg.columns if c not in set(fixed + cube_cols) and not c.startswith("_g_")]
    values = {
        "location_type": F.col("location_type"),
        "size_band": F.lit(ALL),
        "year_built_band": F.lit(ALL),
    }
    for c in cube_cols:
        values[c] = F.when(F.col(f"_g_{c}") == 1, F.lit(ALL)).otherwise(F.col(c))
    for k in ("house_type", "tenure"):
        values.setdefault(k, F.lit(ALL))
    return agg.select(*_key_select(values, by, metrics))


# the location type of groups over all locations, before they are copied
# to every type
EVERY_TYPE = "*"


def grouped_sets(df: DataFrame, aggs: Sequence[Column], by: Sequence[str] = (), dims: Sequence[str] = DIMS) -> DataFrame:
    """The 16 grouping sets with named keys: ``by``, location_type (which of
    the location columns is grouped; ``EVERY_TYPE`` if none), location_value,
    ``dims`` ('all' where rolled up), metrics."""
    loc_cols = [c for _, c in LOCATION_LEVELS]
    loc_choices = [[c] for c in loc_cols] + [[]]
    dim_choices = [
        [d for d, keep in zip(dims, mask) if keep]
        for mask in product([True, False], repeat=len(dims))
    ]
    sets = [[*by, *lc, *dc] for lc in loc_choices for dc in dim_choices]
    grouped = [*loc_cols, *dims]
    flags = [F.grouping(c).alias(f"_g_{c}") for c in grouped]
    agg = df.groupingSets(sets, *by, *grouped).agg(*aggs, *flags)
    metrics = [c for c in agg.columns if c not in set([*by, *grouped]) and not c.startswith("_g_")]
    loc_type = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(t)) for t, c in LOCATION_LEVELS], F.lit(EVERY_TYPE))
    loc_value = F.lit(ALL)
    for _, c in LOCATION_LEVELS:
        loc_value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(loc_value)
    return agg.select(
        *by, loc_type.alias("location_type"), loc_value.alias("location_value"),
        *[F.when(F.col(f"_g_{d}") == 1, F.lit(ALL)).otherwise(F.col(d)).alias(d) for d in dims], *metrics)


def expanded_sets(df: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """Each row once for every one of the 16 sets, with the keys of
    ``grouped_sets`` in place of its location columns and ``dims``. Rows stay
    in their partition: an aggregation by what the rows are partitioned by,
    and the keys, needs no exchange."""
    loc_cols = [c for _, c in LOCATION_LEVELS]
    locations = F.array(*[F.struct(F.lit(t).alias("location_type"), value.alias("location_value"))
                          for t, value in [*[(t, F.col(c)) for t, c in LOCATION_LEVELS], (EVERY_TYPE, F.lit(ALL))]])
    kept = [c for c in df.columns if c not in {*loc_cols, *dims}]
    out = df.select(*kept, *dims, F.inline(locations))
    for d in dims:
        out = out.withColumn(d, F.explode(F.array(d, F.lit(ALL))))
    return out.select(*kept, "location_type", "location_value", *dims)


def copied_to_types(grouped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``grouped_sets`` with groups over all locations once a location type:
    6 key columns, ``by`` columns, metrics."""
    metrics = [c for c in grouped.columns if c not in {*by, *KEY_COLUMNS}]
    types = F.when(F.col("location_type") == EVERY_TYPE, F.array(*[F.lit(t) for t, _ in LOCATION_LEVELS])).otherwise(
        F.array("location_type"))
    values = {k: F.col(k) if k in grouped.columns else F.lit(ALL) for k in KEY_COLUMNS}
    values["location_type"] = F.col("_type")
    return grouped.withColumn("_type", F.explode(types)).select(*_key_select(values, by, metrics))


def segment_cube_gs(
    df: DataFrame,
    aggs: Sequence[Column],
    by: Sequence[str] = (),
    dims: Sequence[str] = DIMS,
) -> DataFrame:
    """Grouping-sets form (16 sets, no fan-out). Same rows as ``segment_cube``."""
    return copied_to_types(grouped_sets(df, aggs, by, dims), by)


def affected_keys(segments: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """For each segment row (the 6 key columns, 'all' allowed) list the keys
    whose aggregates it feeds: the location value and each of ``dims`` either
    kept or replaced by 'all' (8 keys for two dimensions). Adds ``mask``."""
    parts = ["location_value", *dims]
    masks = F.array(*[F.lit(i) for i in range(1 << len(parts))])
    out = segments.select("*", F.explode(masks).alias("mask"))

    def pick(place: int, c: str) -> Column:
        bit = F.lit(1 << (len(parts) - 1 - place))
        return F.when(F.col("mask").bitwiseAND(bit) != 0, F.lit(ALL)).otherwise(F.col(c)).alias(f"affected_{c}")

    return out.select(*[c for c in segments.columns if c not in parts], "mask",
                      *[pick(i, c) for i, c in enumerate(parts)], *parts)
