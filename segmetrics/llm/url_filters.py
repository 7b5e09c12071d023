"""URL filters: a temporal list join. Built-in functions only.

A list's history is a table of dated entries (list_name, pattern, day,
added). Entries become validity intervals: an added pattern holds from its
day until the day of the pattern's next entry, an end that is exclusive. A
capture (url, fetch_day) is blocked if any list holds, on the day of the
fetch, a pattern that covers its URL: the host or a parent domain
(``bad.example``), or a path prefix of whole segments (``host/dir/``). A host
that is an address has no parent domains.

The as-of join equates pattern and time slice: both sides are cut at the
borders of ``SLICE_DAYS``-day slices, so that a pattern with a long history,
or a host with a third of all captures, is spread over slices, and a capture
meets only the intervals alive in its slice. Spark splits slices that stay
large as skewed partitions.

Defined results: a capture without a host or day matches nothing; patterns'
hosts are folded as those of URLs are (lower case, no final dot), their paths
are taken as given; entries without
list, pattern, day or action are ignored; of several entries for a pattern
on one day a removal wins; repeated captures get a row each; empty tables
give empty results or unblocked captures.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.llm.common import let

SLICE_DAYS = 32


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port and final dot;
    empty if there is none."""
    authority = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#\\]*)", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r"^.*@", "")), r":[0-9]*$", "")
    return F.regexp_replace(host, r"\.$", "")


def url_keys(url: Column) -> Column:
    """Every pattern that covers the URL: its host, each parent domain of at
    least two labels, and the host with each prefix of whole path segments."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#\\]*/([^?#]*)", 1)

    def domains(labels: Column) -> Column:
        n = F.size(labels)
        address = F.array_join(labels, ".").rlike(r"^[0-9.]+$|^\[")
        return F.when((n < 2) | address, F.array(F.array_join(labels, "."))).otherwise(F.transform(
            F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), ".")))

    def prefixes(host: Column) -> Column:
        def joined(parts: Column) -> Column:
            return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.concat(
                host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/")))
        # what follows the last slash is a page, not a directory
        return let(F.split(path, "/", -1), lambda p: F.when(F.size(p) < 2, F.array().cast("array<string>")).otherwise(joined(p)))

    return let(host_of(url), lambda h: F.when(h == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.concat(let(F.split(h, r"\.", -1), domains), prefixes(h)))))


def folded(pattern: Column) -> Column:
    """A pattern with its host as ``host_of`` gives hosts."""
    host = F.regexp_replace(F.lower(F.regexp_extract(pattern, "^[^/]*", 0)), r"\.$", "")
    return F.concat(host, F.regexp_extract(pattern, "(?s)/.*$", 0))


def validity(entries: DataFrame) -> DataFrame:
    """Dated entries -> (list_name, pattern, valid_from, valid_to); an open
    end is null. One row per day and pattern enters the window, so a task
    holds at most a pattern's days."""
    known = entries.where("list_name IS NOT NULL AND pattern IS NOT NULL AND day IS NOT NULL AND added IS NOT NULL")
    daily = known.withColumn("pattern", folded(F.col("pattern"))).groupBy("list_name", "pattern", "day").agg(F.bool_and("added").alias("added"))
    after = F.lead("day").over(Window.partitionBy("list_name", "pattern").orderBy("day"))
    return daily.withColumn("valid_to", after).where("added").select(
        "list_name", "pattern", F.col("day").alias("valid_from"), "valid_to")


def _slice(day: Column) -> Column:
    return F.floor(F.datediff(day, F.lit("1970-01-01").cast("date")) / F.lit(SLICE_DAYS)).cast("int")


def filter_urls(captures: DataFrame, entries: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Captures (id_column, url, fetch_day) -> one row per capture:
    id_column, url, fetch_day, host, lists (names, distinct, sorted,
    comma-joined; empty if none), n_matches, blocked."""
    distinct = captures.select(F.col("url"), F.col("fetch_day").cast("date").alias("fetch_day")).distinct()
    sliced = distinct.where("fetch_day IS NOT NULL").select(
        "url", "fetch_day", _slice(F.col("fetch_day")).alias("slice"), F.explode(url_keys(F.col("url"))).alias("key"))
    # an open interval is followed up to the last capture's day, one value
    last = F.lit(distinct.agg(F.max("fetch_day")).first()[0]).cast("date")
    until = F.least(F.coalesce(F.date_sub("valid_to", 1), last), last)
    cut = validity(entries).where(F.col("valid_from") <= until).select(
        "list_name", "pattern", "valid_from", "valid_to",
        F.explode(F.sequence(_slice(F.col("valid_from")), _slice(until))).alias("i_slice"))
    hits = sliced.join(cut, (F.col("key") == F.col("pattern")) & (F.col("slice") == F.col("i_slice"))
                       & (F.col("valid_from") <= F.col("fetch_day"))
                       & (F.col("valid_to").isNull() | (F.col("fetch_day") < F.col("valid_to"))))
    # a URL's matches: at most its keys times the lists
    found = hits.groupBy(F.col("url").alias("m_url"), F.col("fetch_day").alias("m_day")).agg(
        F.array_join(F.array_sort(F.collect_set("list_name")), ",").alias("lists"),
        F.count(F.lit(1)).alias("n_matches"))
    rows = captures.select(id_column, "url", F.col("fetch_day").cast("date").alias("fetch_day"))
    out = rows.join(found, (F.col("url") == F.col("m_url")) & (F.col("fetch_day") == F.col("m_day")), "left")
    return out.select(id_column, "url", "fetch_day", host_of(F.col("url")).alias("host"),
                      F.coalesce("lists", F.lit("")).alias("lists"),
                      F.coalesce("n_matches", F.lit(0).cast("long")).alias("n_matches"),
                      F.col("lists").isNotNull().alias("blocked"))
