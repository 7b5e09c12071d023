"""Ad-hoc line aggregates from the smallest stored table that has what they
need: stored states if their columns cover the predicate, else the sales.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.operators.aggregates import line_partials
from segmetrics.sources.buckets import BUCKET, Version, version, write_version

YEAR = "year_sold"
METRICS = ("avg_price", "sale_count")


@dataclass(frozen=True)
class Aggregate:
    """States (price sum, count) of sales by ``columns`` and year sold."""

    columns: frozenset[str]
    table: Version

    @property
    def rows(self) -> int:
        return sum(n for _, _, n in self.table.files)


def store_aggregates(sales: DataFrame, path: str, groupings: Sequence[Sequence[str]], buckets: int = 4) -> list[Aggregate]:
    """Write one table of states for each list of columns, the widest first;
    each is rolled up from the smallest one before it that has its columns."""
    spark, out = sales.sparkSession, []
    for columns in sorted(groupings, key=lambda c: (-len(c), list(c))):
        keys = [*columns, YEAR]
        source = smallest(out, set(columns))
        if source is None:
            states = sales.groupBy(*keys).agg(*line_partials())
        else:
            states = source.table.read(spark).groupBy(*keys).agg(F.sum("_price_sum").alias("_price_sum"), F.sum("_n").alias("_n"))
        at = f"{path.rstrip('/')}/{'-'.join(columns) or 'all'}"
        write_version(states, at, keys, buckets)
        out.append(Aggregate(frozenset(columns), version(spark, at)))
    return out


def smallest(aggregates: Sequence[Aggregate], columns: set[str]) -> Aggregate | None:
    """The aggregate of the fewest rows that has the columns."""
    fits = [a for a in aggregates if columns - {YEAR} <= a.columns]
    return min(fits, key=lambda a: (a.rows, sorted(a.columns)), default=None)


def adhoc_line(spark: SparkSession, predicate: Column, columns: Sequence[str], aggregates: Sequence[Aggregate],
               sales: DataFrame) -> DataFrame:
    """Average price and count by year of the sales that ``predicate``, over
    ``columns``, selects."""
    source = smallest(aggregates, set(columns))
    if source is None:
        states = sales.where(predicate).select(YEAR, F.col("price").alias("_price_sum"), F.lit(1).cast("long").alias("_n"))
    else:
        states = source.table.read(spark).drop(BUCKET).where(predicate)
    return states.groupBy(YEAR).agg((F.sum("_price_sum") / F.sum("_n")).alias("avg_price"), F.sum("_n").alias("sale_count"))
