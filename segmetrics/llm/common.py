"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmetrics.config import stored  # noqa: F401 - used by the operators

# the white space that separates words, as characters and as a Java regex
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once an
    application; they need not have the repository on their path."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="run-package-"), "segmetrics.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for name in sorted(n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                z.write(file, os.path.relpath(file, os.path.dirname(package)))
    context.addPyFile(path)
    _SHIPPED.add(context.applicationId)


def in_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once. A lambda variable is
    bound to its value, where an inlined expression would be evaluated again
    for every element of a nested lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def n_words(text: Column) -> Column:
    """Number of words (runs without white space) of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores added until no column is called so
    (names compare without case, as Spark compares them)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def content_hash(df: DataFrame, prefix: str = "") -> Column:
    """A hash of a row's columns, those left out that Spark does not hash
    (maps and variants)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return F.xxhash64(*[F.col(f"{prefix}`{c}`") for c, kind in kinds.items() if "map<" not in kind and "variant" not in kind])


def running_total(df: DataFrame, order: list[str], weight: Column, name: str, label: str = "sorted") -> DataFrame:
    """``df`` with the column ``name``: the sum of ``weight`` (long) over all
    rows that come before in ``order``, which must be unique.

    A sort by ranges, written once; a sum a range (as many rows as ranges);
    then each range adds up by itself. No task holds more than a range."""
    part = free_name(df.columns, "range_no")
    total = free_name(df.columns, "range_weight")
    ranged = stored(df.withColumn(total, weight.cast("long")).repartitionByRange(*order).withColumn(
        part, F.spark_partition_id()), label)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy(F.col(part).alias("p")).agg(F.sum(total).alias("s")).select(
        "p", F.coalesce(F.sum("s").over(before), F.lit(0).cast("long")).alias("before_range"))
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    counted = ranged.withColumn(name, F.coalesce(F.sum(total).over(inside), F.lit(0).cast("long")))
    # as many rows as ranges: bounded by the number of partitions
    return counted.join(F.broadcast(starts), F.col(part) == F.col("p")).withColumn(
        name, F.col(name) + F.col("before_range")).select(*df.columns, name)
