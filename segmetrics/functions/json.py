"""JSON edges of the serving tables (export and import).

Typed nested columns are the working form; JSON text only exists at the
export/import edge. Export rounds like the served documents: 2 decimals,
1 for ``pct_sales_appreciated``, half-even; missing pounds print 0.0, missing percent metrics print null.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.functions.keys import segment_key
from segmetrics.functions.text import strip
from segmetrics.schema import DIMENSION_VALUE, PERFORMANCE_VALUE

_OPTS = {"ignoreNullFields": "false"}


def _r(c: Column, digits: int = 2) -> Column:
    """Round a double as the value that it is, half to even. ``bround`` rounds
    its shortest decimal text: where that ends in a 5 at the next digit, the
    value may lie to either side of it. There the side is taken from the
    exact remainder of ``c`` times a power of ten (by splitting ``c`` in two
    halves whose products are exact)."""
    power = float(10 ** (digits + 1))
    whole = F.rint(c * power)
    high = c * 134217729.0 - (c * 134217729.0 - c)
    rest = (high * power - whole) + (c - high) * power
    near_tie = (F.abs(whole) % 10 == 5) & (rest != 0) & (F.abs(rest) < 0.25)
    low = F.floor(F.abs(whole) / 10).cast("double")
    side = F.when((rest > 0) == (c > 0), low + 1).otherwise(low)
    return F.when(near_tie, F.signum(c) * side / float(10 ** digits)).otherwise(F.bround(c, digits))


def export_line_graph(points: Column) -> Column:
    return F.transform(
        points,
        lambda p: F.struct(
            F.coalesce(p["year_sold"], F.lit("")).alias("year_sold"),
            _r(F.coalesce(p["avg_price"], F.lit(0.0))).alias("avg_price"),
            _r(F.coalesce(p["median_price"], F.lit(0.0))).alias("median_price"),
            _r(F.coalesce(p["mode_price"], F.lit(0.0))).alias("mode_price"),
            F.coalesce(p["sale_count"], F.lit(0).cast("bigint")).alias("sale_count"),
        ),
    )


def export_heatmap_graph(cells: Column) -> Column:
    return F.transform(
        cells,
        lambda c: F.struct(
            F.coalesce(c["year_bought"], F.lit("")).alias("year_bought"),
            F.coalesce(c["year_sold"], F.lit("")).alias("year_sold"),
            _r(F.coalesce(c["avg_appreciation_pounds"], F.lit(0.0))).alias("avg_appreciation_pounds"),
            _r(F.coalesce(c["median_appreciation_pounds"], F.lit(0.0))).alias("median_appreciation_pounds"),
            F.coalesce(c["sale_count"], F.lit(0).cast("bigint")).alias("sale_count"),
            _r(c["avg_appreciation_pct"]).alias("avg_appreciation_pct"),
            _r(c["median_appreciation_pct"]).alias("median_appreciation_pct"),
            _r(F.coalesce(c["pct_sales_appreciated"], F.lit(0.0)), 1).alias("pct_sales_appreciated"),
            _r(c["biggest_loser_pounds"]).alias("biggest_loser_pounds"),
            _r(c["biggest_loser_pct"]).alias("biggest_loser_pct"),
            _r(c["biggest_winner_pounds"]).alias("biggest_winner_pounds"),
            _r(c["biggest_winner_pct"]).alias("biggest_winner_pct"),
        ),
    )


def performance_to_json(perf: DataFrame) -> DataFrame:
    """Performance table -> (key, value) with value =
    {line_graph, heatmap_graph, sale_count}."""
    value = F.struct(
        export_line_graph(F.coalesce("line_graph", F.array())).alias("line_graph"),
        export_heatmap_graph(F.coalesce("heatmap_graph", F.array())).alias("heatmap_graph"),
        F.coalesce(F.col("sale_count"), F.lit(0).cast("bigint")).alias("sale_count"),
    )
    return perf.select(segment_key().alias("key"), F.to_json(value, _OPTS).alias("value"))


def dimension_to_json(index: DataFrame) -> DataFrame:
    """Dimension index -> (key 'meta#<dimension>', value {sk, label, sale_count})."""
    value = F.struct(
        F.col("value").alias("sk"), F.col("label"), F.col("sale_count").cast("bigint").alias("sale_count")
    )
    return index.select(
        F.concat(F.lit("meta#"), F.col("dimension_name")).alias("key"), F.to_json(value).alias("value")
    )


def parsed_once(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with ``text`` parsed into the VARIANT column ``name``, null for
    blank or malformed JSON. The one-element ``explode`` keeps the optimizer
    from copying the parse into every place that reads the column."""
    value = F.col(text)
    variant = F.when(value.isNotNull() & (strip(value) != ""), F.try_parse_json(value))
    return df.select("*", F.explode(F.array(variant)).alias(name))


def performance_field(variant: str, field: str) -> Column:
    """A field of a parsed performance value, null if it is not of its type."""
    return F.try_variant_get(F.col(variant), f"$.{field}", PERFORMANCE_VALUE[field].dataType.simpleString())


def dimension_field(variant: str, field: str) -> Column:
    return F.try_variant_get(F.col(variant), f"$.{field}", DIMENSION_VALUE[field].dataType.simpleString())
