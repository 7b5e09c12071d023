"""Parquet table reader and the adapter that derives a raw sale file from
the driver's TPC-H-like tables.

Adapter (every lineitem row is one sale; strings as a raw file would hold them):

=====================  =====================================================
transaction_id         ``<l_orderkey>-<l_linenumber>``
price                  whole units of ``l_extendedprice`` (floor), as text
date_of_transfer       ``l_shipdate`` as ``yyyy-MM-dd HH:mm``
postcode               ``E<l_partkey % 50> <l_suppkey % 9>AB`` (case varies)
property_type          code by ``l_partkey % 6``: D S T F O X (case varies)
duration               ``l_returnflag``: A -> F, N -> L, R -> U
paon / saon / street   partkey / 'Flat n' for flats / supplier name
district               supplier nation name (case varies)
county                 supplier region name (case and blanks vary)
=====================  =====================================================

A property is therefore one (part, supplier) pair, sold again and again;
locations are fixed per property while tenure varies per sale. The text noise
(case, padding, doubled blanks, '#') is removed again by cleaning.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.operators.joins import join_dimension
from segmetrics.schema import RAW_COLUMNS


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _s(c) -> F.Column:
    return c.cast("string")


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt out by ``key`` if its scan has fewer splits than the
    session has cores, as the test tables do (one row group each); a larger
    table is left to the reader's splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(key) if df.rdd.getNumPartitions() < cores else df


def raw_sales_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw sale rows (16 string columns) derived from lineitem + supplier +
    nation + region."""
    li = spread(read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice", "l_returnflag", "l_shipdate",
    ), "l_orderkey")
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    df = join_dimension(li, supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    df = join_dimension(df, nation, F.col("s_nationkey") == F.col("n_nationkey"))
    df = join_dimension(df, region, F.col("n_regionkey") == F.col("r_regionkey"))

    ln = F.col("l_linenumber")
    part = F.col("l_partkey")
    # property code by part, lower case on even line numbers (one lookup)
    codes = F.array(*[F.lit(x) for x in "DSTFOXdstfox"])
    code = F.element_at(codes, (part % 6 + 1 + F.when(ln % 2 == 0, 6).otherwise(0)).cast("int"))
    # upper case, or lower case with a trailing blank on every 4th line
    low = ln % 4 == 3
    postcode = F.concat(
        F.when(low, F.lit("e")).otherwise(F.lit("E")), _s(part % 50), F.lit(" "), _s(F.col("l_suppkey") % 9),
        F.when(low, F.lit("ab ")).otherwise(F.lit("AB")),
    )
    county = (
        F.when(ln % 3 == 0, F.col("r_name"))
        .when(ln % 3 == 1, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
        .otherwise(F.replace(F.col("r_name"), F.lit(" "), F.lit("  ")))
    )
    cols = {
        "transaction_id": F.concat(_s(F.col("l_orderkey")), F.lit("-"), _s(ln)),
        "price": _s(F.floor("l_extendedprice").cast("bigint")),
        "date_of_transfer": F.date_format("l_shipdate", "yyyy-MM-dd HH:mm"),
        "postcode": postcode,
        "property_type": code,
        "old_new": F.lit("N"),
        "duration": F.translate(F.col("l_returnflag"), "ANR", "FLU"),
        "paon": _s(part),
        "saon": F.when(part % 6 == 3, F.concat(F.lit("Flat "), _s(F.col("l_suppkey") % 4))).otherwise(F.lit("")),
        "street": F.col("s_name"),
        "locality": F.lit(""),
        "town": F.col("n_name"),
        "district": F.when(ln % 2 == 0, F.col("n_name")).otherwise(F.lower("n_name")),
        "county": county,
        "ppd_category_type": F.lit("A"),
        "record_status": F.lit("A"),
    }
    return df.select(*[cols[c].alias(c) for c in RAW_COLUMNS])
