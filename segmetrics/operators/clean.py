"""Cleaning: parse price and date, drop unparseable rows, derive segment
columns and the property id. Native expressions only (ANSI-safe ``try_*``).

A sale is rejected if its price or date does not parse, or if a segment
value reads ``all``: that is the key of the roll-ups, and such a sale would
count twice in them. ``rejected_sales`` returns these rows with the reason."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.functions.text import (
    house_type,
    normalise_of_spaced,
    normalise_or_empty_of_spaced,
    outcode_of_spaced,
    spaced,
    tenure,
)
from segmetrics.schema import ALL, PROPERTY_DELIMITER
from segmetrics.sources.csv import resolve_roles

SALE_COLUMNS = [
    "transaction_id",
    "property_id",
    "price",
    "sale_date",
    "year_sold",
    "county",
    "outcode",
    "district",
    "house_type",
    "tenure",
]


SEGMENT_COLUMNS = ["county", "outcode", "district", "house_type", "tenure"]


def _day(text: Column) -> Column:
    """The date of a yyyy-MM-dd text. Texts of that very form are cast, which
    costs a fraction of a parse by pattern; the pattern decides on others."""
    plain = text.rlike("^[12][0-9]{3}-[0-9]{2}-[0-9]{2}$")
    return F.when(plain, text.try_cast("date")).otherwise(F.try_to_date(text, "yyyy-MM-dd"))


def _parsed(roles: DataFrame) -> DataFrame:
    """``price`` (double), ``sale_date`` (date) and ``year_sold`` (int), null
    where the text does not parse."""
    price = F.col("price").try_cast("double")
    text = roles.withColumns({"price": price, "_day": F.substring(F.trim(F.col("date")), 1, 10)})
    return text.withColumn("sale_date", _day(F.col("_day"))).drop("_day").withColumn("year_sold", F.year("sale_date"))


def kept_rows(df: DataFrame, keep: Column) -> DataFrame:
    """The rows for which ``keep`` holds. A plain filter would be pushed below
    the columns that it reads, down to the scan, and compute them a second
    time there; the one-element ``explode`` keeps it where they are."""
    return df.withColumn("_keep", F.explode(F.array(F.coalesce(keep, F.lit(False))))).where("_keep").drop("_keep")


def parses() -> Column:
    return F.col("price").isNotNull() & F.col("sale_date").isNotNull()


def parse_price_date(roles: DataFrame) -> DataFrame:
    """Add ``price``, ``sale_date`` and ``year_sold``; rows whose price or
    date does not parse are dropped, not raised."""
    return kept_rows(_parsed(roles), parses())


def reserved(columns: list[str] = SEGMENT_COLUMNS) -> Column:
    """True for a sale with a segment value that is the roll-up key."""
    out = F.lit(False)
    for c in columns:
        out = out | (F.col(c) == ALL)
    return out


def borough_predicate(value: str) -> Column:
    """Pre-filter on the raw district: lower(trim(district)) == value."""
    return F.lower(F.trim(F.col("district"))) == F.lit(value.strip().lower())


def prefilter(parsed: DataFrame, predicate: Column | None) -> DataFrame:
    """Optional pre-filter before any expansion (pushed into the scan where
    the predicate allows it)."""
    return parsed if predicate is None else parsed.where(predicate)


def segment_columns(
    parsed: DataFrame, require_address: bool = False, extra: dict[str, Column] | None = None
) -> DataFrame:
    """Normalised segment attributes and the property id; narrow output.
    ``extra`` adds named columns (e.g. a normalised street) in the same pass;
    they may read the ``spaced`` texts, as ``_street``."""
    texts = ["postcode", "paon", "saon", "street", "county", "district"]
    spaced_texts = parsed.select("*", *[spaced(c).alias(f"_{c}") for c in texts])
    address = {c: f"_{c}" for c in ("postcode", "paon", "saon", "street")}
    no_address = [F.coalesce(F.col(f"_{c}"), F.lit("")) == "" for c in ("paon", "saon", "street")]
    out = spaced_texts.select(
        F.col("transaction_id"),
        normalise_or_empty_of_spaced(address, PROPERTY_DELIMITER).alias("property_id"),
        F.col("price"),
        F.col("sale_date"),
        F.col("year_sold"),
        normalise_of_spaced("_county").alias("county"),
        outcode_of_spaced("_postcode").alias("outcode"),
        normalise_of_spaced("_district").alias("district"),
        house_type(F.col("property_type")).alias("house_type"),
        tenure(F.col("duration")).alias("tenure"),
        (no_address[0] & no_address[1] & no_address[2]).alias("_no_address"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    if require_address:
        # sales without any address part would all share one property per
        # postcode and pair up as false repeat sales
        out = out.where(~F.col("_no_address"))
    return out.drop("_no_address")


def clean_sales(
    raw: DataFrame,
    predicate: Column | None = None,
    require_address: bool = False,
    keep_reserved: bool = False,
    roles: dict[str, str] | None = None,
) -> DataFrame:
    """Raw sale table -> clean sales. ``roles`` names columns where the role
    rules don't settle them; ``keep_reserved`` keeps the sales whose segment
    values read ``all`` (for reports, never for the cube)."""
    parsed = prefilter(_parsed(resolve_roles(raw, roles)), predicate)
    sales = segment_columns(parsed, require_address)
    return kept_rows(sales, parses() if keep_reserved else parses() & ~reserved())


def rejected_sales(raw: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """The raw sales that ``clean_sales`` leaves out: transaction_id and the
    first reason that holds: price, date or reserved."""
    parsed = _parsed(resolve_roles(raw, roles))
    marked = segment_columns(parsed).withColumn("reason", F.when(F.col("price").isNull(), "price").when(
        F.col("sale_date").isNull(), "date").when(reserved(), "reserved"))
    return marked.where(F.col("reason").isNotNull()).select("transaction_id", "reason")


def reserved_value_report(sales: DataFrame) -> DataFrame:
    """Data-quality check: rows whose cleaned segment value is the literal
    'all' (it would collide with the roll-up key), and rows without any
    address part (they pair up as false repeat sales). One pass, one row."""
    counts = [F.count_if(F.col(c) == ALL).alias(f"{c}_all") for c in SEGMENT_COLUMNS]
    no_address = F.count_if(F.col("property_id").rlike(r"^[^|]*\|\|\|$")).alias("no_address")
    return sales.agg(F.count(F.lit(1)).alias("sales"), *counts, no_address)
