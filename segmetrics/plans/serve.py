"""Serving reads as batch DataFrame operators.

A *request* row is (request_id, location_type, location_value, house_type,
tenure, size_band, year_built_band). Requests are validated, normalised the
way a lookup key is built, and equi-joined to the performance table on the
six key columns; the optimizer picks broadcast or shuffle join from the
sizes it sees (AQE re-plans at runtime), so a large request batch still
works.

A table read from a bucketed version (``sources.buckets``) has the column
``bucket``. ``segment_in`` reads the one bucket of a key; with ``buckets``,
the number of them, a batch joins on its requests' buckets too, which prunes
the table's files at run time by the buckets that the batch asks for.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.functions.keys import lookup_part
from segmetrics.functions.text import strip
from segmetrics.operators.merge import merge_heatmap, merge_line
from segmetrics.schema import ALL, KEY_COLUMNS, REQUEST_LOCATION_TYPES, SERVED_CELL_FIELDS
from segmetrics.sources.buckets import BUCKET, Version, bucket_of

_DIMS = ["house_type", "tenure", "size_band", "year_built_band"]


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds ``valid`` (bool) and ``reason`` (null when valid): location type
    must be one of the known types, location value at least one character."""
    bad_type = ~F.coalesce(F.col("location_type").isin(REQUEST_LOCATION_TYPES), F.lit(False))
    bad_value = F.col("location_value").isNull() | (F.length("location_value") < 1)
    reason = F.when(bad_type, F.lit("location_type")).when(bad_value, F.lit("location_value"))
    return requests.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def normalise_requests(requests: DataFrame) -> DataFrame:
    """Key parts as the lookup builds them: location value strip + lower
    (strip only for street); other parts blank -> 'all', strip + lower."""
    loc = F.when(F.col("location_type") == "street", strip("location_value")).otherwise(
        F.lower(strip("location_value"))
    )
    cols = [c for c in requests.columns if c not in KEY_COLUMNS]
    return requests.select(
        *cols,
        F.col("location_type"),
        loc.alias("location_value"),
        *[lookup_part(d).alias(d) for d in _DIMS],
    )


def served_shape(perf: DataFrame) -> DataFrame:
    """Performance rows as served: line points with null -> 0; heatmap cells
    keep 8 fields, null pounds/count/share -> 0, null percent stays null."""
    zero = F.lit(0.0)
    line = F.transform(
        "line_graph",
        lambda p: F.struct(
            F.coalesce(p["year_sold"], F.lit("")).alias("year_sold"),
            F.coalesce(p["avg_price"], zero).alias("avg_price"),
            F.coalesce(p["median_price"], zero).alias("median_price"),
            F.coalesce(p["mode_price"], zero).alias("mode_price"),
            F.coalesce(p["sale_count"], F.lit(0).cast("bigint")).alias("sale_count"),
        ),
    )
    keep_null = {"avg_appreciation_pct", "median_appreciation_pct"}

    def cell(c):
        fields = []
        for f in SERVED_CELL_FIELDS:
            v = c[f]
            if f in ("year_bought", "year_sold"):
                v = F.coalesce(v, F.lit(""))
            elif f == "sale_count":
                v = F.coalesce(v, F.lit(0).cast("bigint"))
            elif f not in keep_null:
                v = F.coalesce(v, zero)
            fields.append(v.alias(f))
        return F.struct(*fields)

    others = [c for c in perf.columns if c not in ("line_graph", "heatmap_graph")]
    return perf.select(
        *others,
        line.alias("line_graph"),
        F.transform("heatmap_graph", cell).alias("heatmap_graph"),
    )


def _key_values(location_type: str, location_value: str, *dims: str) -> dict[str, str]:
    loc = location_value.strip() if location_type == "street" else location_value.strip().lower()
    return {"location_type": location_type, "location_value": loc, **{d: (v or ALL).strip().lower() for d, v in zip(_DIMS, dims)}}


def lookup_segment(perf: DataFrame, location_type: str, location_value: str, house_type: str = ALL,
                   tenure: str = ALL, size_band: str = ALL, year_built_band: str = ALL) -> DataFrame:
    """Exact segment: six equality predicates."""
    parts = _key_values(location_type, location_value, house_type, tenure, size_band, year_built_band)
    return perf.where(reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in parts.items()]))


def segment_in(spark: SparkSession, table: Version, location_type: str, location_value: str, house_type: str = ALL,
               tenure: str = ALL, size_band: str = ALL, year_built_band: str = ALL) -> DataFrame:
    """Exact segment of a bucketed table: the key's bucket is a constant that
    prunes the files, and the key skips row groups in the one left."""
    dims = (house_type, tenure, size_band, year_built_band)
    parts = _key_values(location_type, location_value, *dims)
    own = bucket_of([F.lit(parts[k]) for k in table.keys], table.buckets)
    return lookup_segment(table.read(spark).where(F.col(BUCKET) == own), location_type, location_value, *dims).drop(BUCKET)


def valid_requests(requests: DataFrame) -> DataFrame:
    """The valid requests with their key parts as the lookup builds them."""
    return normalise_requests(validate_requests(requests).where("valid").drop("valid", "reason"))


def rejected_requests(requests: DataFrame) -> DataFrame:
    """The requests that no query answers, with the reason."""
    return validate_requests(requests).where("NOT valid").drop("valid")


def _asked(requests: DataFrame, buckets: int | None) -> tuple[DataFrame, list[str]]:
    """Valid requests, and the columns on which they meet the table."""
    valid = valid_requests(requests)
    if buckets is None:
        return valid, KEY_COLUMNS
    return valid.withColumn(BUCKET, bucket_of(KEY_COLUMNS, buckets)), [BUCKET, *KEY_COLUMNS]


def lookup(perf: DataFrame, requests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Matched items per valid request (0 or 1 row per request), served shape."""
    # shape only the matched rows: the join runs on the stored table
    asked, on = _asked(requests, buckets)
    return served_shape(asked.join(perf, on, "inner")).drop(BUCKET)


ALONE = "_alone"


def _marked_lookup(perf: DataFrame, requests: DataFrame, buckets: int | None = None) -> DataFrame:
    """``lookup`` with the column ``ALONE``: the item is the only one of its
    request id. It is found by the keys alone, before the items are read."""
    asked, on = _asked(requests, buckets)
    found = asked.join(perf.select(*on), on).groupBy(F.col("request_id").alias("_id")).agg((F.count(F.lit(1)) == 1).alias(ALONE))
    marked = asked.join(found, F.col("request_id").eqNullSafe(F.col("_id"))).drop("_id")
    return served_shape(marked.join(perf, on, "inner")).drop(BUCKET)


def list_performance(perf: DataFrame, requests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per valid request: ``count`` of matched items beside the items'
    content (null when nothing matched)."""
    matched = lookup(perf, requests, buckets).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("count"), F.collect_list(F.struct("line_graph", "heatmap_graph", "sale_count")).alias("items"))
    answers = _answers(requests, matched)
    none = F.array().cast(matched.schema["items"].dataType)
    return answers.select("request_id", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("items", none).alias("items"))


def _answers(requests: DataFrame, merged: DataFrame) -> DataFrame:
    """Every valid request with its merged rows; one row of nulls if none."""
    return valid_requests(requests).select("request_id").distinct().join(merged, "request_id", "left")


def query_line(perf: DataFrame, requests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Line series per request (merged by year when several items match); a
    request without a match, or without points, has one row, its year null."""
    return _answers(requests, merge_line(_marked_lookup(perf, requests, buckets), "request_id", alone=ALONE))


def query_heatmap(perf: DataFrame, requests: DataFrame, buckets: int | None = None) -> DataFrame:
    """Heatmap cells per request (merged by year pair when several items
    match); a request without cells has one row, its years null."""
    return _answers(requests, merge_heatmap(_marked_lookup(perf, requests, buckets), "request_id", alone=ALONE))
