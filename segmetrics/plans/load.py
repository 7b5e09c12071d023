"""Batch load: read a (key, value) export, apply it in the order of its files
and rows, and write the serving table's next version.

Tables are bucketed by key (``sources.buckets``). A load reads and rewrites
the buckets that its own keys fall into; the next version takes over the
files of all others. A path is never overwritten while it is read, and a
failed load leaves the table as it was.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmetrics.config import stored
from segmetrics.operators.upsert import DIMENSION_KEYS, last_of_load, observed_load, upsert
from segmetrics.schema import KEY_COLUMNS
from segmetrics.sources.buckets import BUCKET, BUCKETS, Version, version, write_version
from segmetrics.sources.csv import LOAD_PLACE, read_key_value_csv

KINDS = {"performance": KEY_COLUMNS, "dimension": DIMENSION_KEYS}


def read_current(spark: SparkSession, table: str) -> DataFrame | None:
    """The newest version's rows, or None if the table has none."""
    found = version(spark, table)
    return None if found is None else found.read(spark).drop(BUCKET)


def apply_load(rows: DataFrame, table: str, keys: list[str], buckets: int = BUCKETS) -> tuple[Version, list[int]]:
    """Upsert typed rows, a stored table, into a bucketed table; the new
    version, and the buckets that were rewritten (as many numbers as the
    table has buckets at most)."""
    spark = rows.sparkSession
    now = version(spark, table)
    if now is None:
        order = [c for c in ("load_seq", *LOAD_PLACE) if c in rows.columns]
        first = write_version(last_of_load(rows, keys, order), table, keys, buckets)
        return first, sorted({f[0] for f in first.files})
    touched = sorted(r[0] for r in rows.select(now.bucket()).distinct().collect())
    after = upsert(now.read(spark, touched).drop(BUCKET), rows, keys)
    return write_version(after, table, keys, last=now, touched=touched), touched


def load_export(spark: SparkSession, source: str | list[str], table: str, kind: str = "performance",
                buckets: int = BUCKETS) -> dict[str, int]:
    """Apply an export to a table; returns the version, how many buckets were
    written, and the rows read, rejected and loaded."""
    rows, seen = observed_load(read_key_value_csv(spark, source, with_place=True), kind, keep=LOAD_PLACE)
    rows = stored(rows, f"load-{kind}")  # fills the counts, too
    after, touched = apply_load(rows, table, KINDS[kind], buckets)
    return {"version": after.number, "buckets_written": len(touched), **seen.get}
