"""Bucketed tables with a manifest per version.

    table/data/version=000003/bucket=17/part-....parquet
    table/manifest/version=000003/part-....parquet

A row lies in the bucket of its key's hash; in a bucket's files rows are
sorted by key, so that a reader skips row groups by their least and greatest
keys. A version's manifest lists its files: those written for it, and those
of older versions for the buckets it left alone. So a load rewrites the
buckets of its own keys and nothing else, and what it writes is not read by
anybody before its manifest is complete.

A manifest has one header row (number of buckets, keys, schema, number of
files) and a row for each file. It is complete when it has as many file rows
as the header says; an incomplete one is left over from a write that failed,
and its number is used again. One writer at a time.
"""
from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket"
BUCKETS = 32
ROW_GROUP_BYTES = 16 << 20
_MANIFEST = ("bucket int, path string, file_rows long, buckets int, keys array<string>, schema string, files long, "
             "version int")


def bucket_of(keys: Sequence[str | Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def version_path(table: str, part: str, number: int) -> str:
    return f"{table.rstrip('/')}/{part}/version={number:06d}"


@dataclass(frozen=True)
class Version:
    """One complete version of a table."""

    table: str
    number: int
    keys: tuple[str, ...]
    buckets: int
    schema: T.StructType
    files: tuple[tuple[int, str, int], ...]  # bucket, path below the table, rows

    def bucket(self) -> Column:
        """The bucket of a row that has the key columns."""
        return bucket_of(self.keys, self.buckets)

    def read(self, spark: SparkSession, only: Iterable[int] | None = None) -> DataFrame:
        """The rows, with their bucket as the column ``bucket``, which prunes
        files; ``only``: of these buckets, without opening other files."""
        wanted = None if only is None else set(only)
        paths = [f"{self.table.rstrip('/')}/{path}" for b, path, _ in self.files if wanted is None or b in wanted]
        schema = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        if not paths:
            return spark.createDataFrame([], schema)
        base = f"{self.table.rstrip('/')}/data"
        # the files' version is a partition column, too
        return spark.read.schema(schema).option("basePath", base).parquet(*paths).select(*schema.fieldNames())


def _manifests(spark: SparkSession, table: str) -> DataFrame | None:
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{table.rstrip('/')}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def versions(spark: SparkSession, table: str) -> list[int]:
    """Numbers of the complete versions of a table, in order."""
    found = _manifests(spark, table)
    if found is None:
        return []
    full = found.groupBy("version").agg(F.count("path").alias("listed"), F.max("files").alias("files")).where("listed = files")
    return sorted(r["version"] for r in full.select("version").collect())


def version(spark: SparkSession, table: str, number: int | None = None) -> Version | None:
    """A version, by default the newest; None if the table has none. The
    file list comes to the driver, as any reader's does."""
    if number is None:
        numbers = versions(spark, table)
        if not numbers:
            return None
        number = numbers[-1]
    rows = _manifests(spark, table).where(F.col("version") == number).collect()
    head = next(r for r in rows if r["path"] is None)
    files = sorted((r["bucket"], r["path"], r["file_rows"]) for r in rows if r["path"] is not None)
    return Version(table, number, tuple(head["keys"]), head["buckets"], T.StructType.fromJson(json.loads(head["schema"])), tuple(files))


def write_version(rows: DataFrame | Sequence[DataFrame], table: str, keys: Sequence[str], buckets: int = BUCKETS,
                  last: Version | None = None, touched: Iterable[int] | None = None) -> Version:
    """Write the next version: ``rows`` in their buckets, and of ``last`` the
    files of all buckets that are not ``touched`` (default: all are). Keys
    and buckets stay those of ``last``. Several ``rows`` are written one after
    the other; they have their bucket as the column ``bucket``, and are dealt
    out so that few tasks share one."""
    if last is not None:
        keys, buckets = last.keys, last.buckets
    if isinstance(rows, DataFrame):
        rows = rows if last is None else rows.select(*last.schema.fieldNames())
        rows = [rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET)]
    spark, schema = rows[0].sparkSession, rows[0].drop(BUCKET).schema if last is None else last.schema
    numbers = versions(spark, table)
    number = (numbers[-1] if numbers else 0) + 1
    path = version_path(table, "data", number)
    for i, placed in enumerate(rows):
        placed.select(*schema.fieldNames(), BUCKET).sortWithinPartitions(BUCKET, *keys).write.mode(
            "append" if i else "overwrite").partitionBy(BUCKET).option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    try:
        written = spark.read.schema(T.StructType([T.StructField(BUCKET, T.IntegerType())])).parquet(path)
        counts = written.groupBy(BUCKET, F.col("_metadata.file_path").alias("path")).count()
        below = F.regexp_extract("path", r"(data/version=\d+/bucket=\d+/[^/]+)$", 1)
        mine = [(r[BUCKET], r["path"], r["count"]) for r in counts.withColumn("path", below).collect()]
    except AnalysisException as e:  # no rows, no folder
        if "PATH_NOT_FOUND" not in str(e):
            raise
        mine = []
    gone = None if touched is None else set(touched)
    old = [] if last is None or gone is None else [f for f in last.files if f[0] not in gone]
    files = sorted([*mine, *old])
    head = (None, None, None, buckets, list(keys), schema.json(), len(files))
    listed = [(b, p, n, None, None, None, None) for b, p, n in files]
    fields = T.StructType(T._parse_datatype_string(_MANIFEST).fields[:-1])
    spark.createDataFrame([head, *listed], fields).coalesce(1).write.mode("overwrite").parquet(
        version_path(table, "manifest", number))
    return Version(table, number, tuple(keys), buckets, schema, tuple(files))
