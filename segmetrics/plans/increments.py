"""Incremental builds on bucketed tables: what new sales change, and no more.

* **Line cube.** The table holds, for each segment and year sold, the
  mergeable state (price sum, count). New sales become the cube of their own
  states; the buckets of their segments are read, added up, and rewritten.
  Nothing else is: neither old sales nor other buckets.
* **Pairs.** The table holds the sales, each with its predecessor, bucketed by
  property. New sales pair with all sales of their own properties, so a late
  one between two known ones becomes the predecessor of the later. Only the
  buckets of these properties are read, and in them only these are paired,
  unless the load is large beside them: then whole buckets are, without joins
  that look for the others. That takes one exchange, which pairs the sales and
  places them for the writer, and a large load makes it in ``ROUNDS`` rounds of
  buckets, so that a fraction of it is on disk at once; nor do the load's copy
  and the shuffle files of a round stay there.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.config import sparing_disk, stored, stored_for_now
from segmetrics.operators.aggregates import line_metrics_from_partials, line_partials
from segmetrics.operators.cube import DIMS, affected_keys, copied_to_types, grouped_sets, location_fanout
from segmetrics.operators.repeat import placed_with_predecessor, with_predecessor
from segmetrics.plans.build import LINE_BASE
from segmetrics.schema import ALL, KEY_COLUMNS
from segmetrics.sources.buckets import BUCKET, BUCKETS, Version, bucket_of, version, write_version

STATES = ["_price_sum", "_n"]
PAIR = ["bought_date", "bought_price", "bought_year"]
# A load of more than one row to this many in its buckets is large.
SMALL_LOAD = 10
# Sales that a task pairs, and sales above which a load takes several rounds,
# each of which reads the load's copy.
PART_ROWS = 1_000_000
ROUND_ROWS = 10_000_000
ROUNDS = 4


def line_states(sales: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """(segment, year sold) -> price sum and count."""
    finest = [*[c for c in LINE_BASE if c != "price"], *dims]
    partials = sales.groupBy(*finest).agg(*line_partials())
    sums = [F.sum(c).alias(c) for c in STATES]
    return copied_to_types(grouped_sets(partials, sums, ["year_sold"], dims), ["year_sold"])


def line_from_states(states: DataFrame) -> DataFrame:
    """The line metrics of stored states."""
    return states.groupBy(*KEY_COLUMNS, "year_sold").agg(*line_metrics_from_partials())


def touched_segments(sales: DataFrame, dims: Sequence[str] = DIMS) -> DataFrame:
    """The keys of all segments that the sales count towards."""
    fixed = [F.lit(ALL).alias(k) for k in KEY_COLUMNS if k not in ("location_type", "location_value", *dims)]
    own = location_fanout(sales.select(*[c for c in LINE_BASE if c not in ("price", "year_sold")], *dims).distinct()).select("*", *fixed)
    renamed = affected_keys(own, dims)
    return renamed.select(*[F.col(f"affected_{k}").alias(k) if k in ("location_value", *dims) else F.col(k) for k in KEY_COLUMNS]).distinct()


def _touched(now: Version, rows: DataFrame) -> list[int]:
    """Buckets of the rows' keys: at most as many as the table has."""
    return sorted(r[0] for r in rows.select(now.bucket()).distinct().collect())


def add_to_line(sales: DataFrame, table: str, dims: Sequence[str] = DIMS, buckets: int = BUCKETS) -> Version:
    """Add new sales to the table of line states."""
    delta = stored(line_states(sales, dims), "line-delta")
    now = version(delta.sparkSession, table)
    if now is None:
        return write_version(delta, table, KEY_COLUMNS, buckets)
    touched = _touched(now, delta)
    old = now.read(delta.sparkSession, touched).drop(BUCKET)
    merged = old.unionByName(delta).groupBy(*KEY_COLUMNS, "year_sold").agg(*[F.sum(c).alias(c) for c in STATES])
    return write_version(merged, table, KEY_COLUMNS, last=now, touched=touched)


def _paired_buckets(fresh: DataFrame, bucket: Column, per_bucket: dict[int, int], now: Version | None = None) -> list[DataFrame]:
    """All sales of the buckets, the table's and the new ones, each with its
    predecessor: for each round the rows of its buckets."""
    rows, wanted = sum(per_bucket.values()), sorted(per_bucket)
    parts = -(-rows // (PART_ROWS * max(1, len(wanted))))
    rounds = max(1, min(ROUNDS, len(wanted), -(-rows // ROUND_ROWS)))
    out = []
    for i in range(rounds):
        mine = wanted[i * len(wanted) // rounds:(i + 1) * len(wanted) // rounds]
        sales = fresh if rounds == 1 else fresh.where(bucket.isin(mine))
        if now is not None:
            sales = now.read(fresh.sparkSession, mine).drop(BUCKET, *PAIR).unionByName(sales)
        out.append(placed_with_predecessor(sales.withColumn(BUCKET, bucket), BUCKET, max(1, parts)))
    return out


def add_to_pairs(sales: DataFrame, table: str, buckets: int = BUCKETS) -> Version:
    """Add new sales to the table of paired sales."""
    spark, keys = sales.sparkSession, ["property_id"]
    with sparing_disk(spark), stored_for_now(sales, "new-sales") as fresh:
        now = version(spark, table)
        bucket = bucket_of(keys, buckets) if now is None else now.bucket()
        added = {r[0]: r[1] for r in fresh.groupBy(bucket).count().collect()}
        if now is None:
            return write_version(_paired_buckets(fresh, bucket, added), table, keys, buckets)
        touched = sorted(added)
        held = {b: sum(n for c, _, n in now.files if c == b) for b in touched}
        if sum(added.values()) * SMALL_LOAD > sum(held.values()):
            per_bucket = {b: added[b] + held[b] for b in touched}
            return write_version(_paired_buckets(fresh, bucket, per_bucket, now), table, keys, last=now, touched=touched)
        old = now.read(spark, touched).drop(BUCKET)
        mine = fresh.select(F.col("property_id").alias("_p")).distinct()
        is_mine = F.col("property_id") == F.col("_p")
        with stored_for_now(old.join(mine, is_mine, "left_semi").drop(*PAIR).unionByName(fresh), "paired-again") as again:
            others = old.join(mine, is_mine, "left_anti")
            return write_version(others.unionByName(with_predecessor(again)), table, keys, last=now, touched=touched)
