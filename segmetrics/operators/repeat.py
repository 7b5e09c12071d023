"""Repeat sales: pair every sale with the previous sale of the same property.

Order inside a property is (sale_date, price, transaction_id). The pairing
equals a per-property ``lag``, and is one for all properties but the
``HOT_PROPERTIES`` with the most sales, if these have over ``HOT_SALES``:
one exchange of the sales by property, one sort. The hot ones are found by
counting ids, and are few enough to broadcast; a window over one of them
would be a large task, so their sales are paired in parts:

1. Parts. The sales of a property are cut by day and price band, a cut that
   follows their order. A window over each part pairs all but its first sale.
2. Carry. The last sale of each part goes to the next part of its property:
   a window over one narrow row per part, so over at most days x bands of a
   property, whatever the number of its sales.
3. The first sale of each part takes what is carried there.

A bulk of sales with one property, day and price is one part still; it pairs
with itself at equal date and price, so only its first sale needs finding.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PD = ["property_id", "sale_date"]
HOT_SALES = 100_000
HOT_PROPERTIES = 10_000


def _band(price: Column) -> Column:
    """Price band, growing with the price: sixteen to each doubling; one for
    what isn't positive, and one each for infinity and NaN, which sort last."""
    return (F.when(F.isnan(price), F.lit(1 << 20)).when(price == float("inf"), F.lit((1 << 20) - 1))
            .when(price > 0, F.floor(F.log2(price) * 16).cast("int")).otherwise(F.lit(-(1 << 20))))


def _bought(paired: DataFrame, columns: list[str], date: Column, price: Column) -> DataFrame:
    return paired.select(*columns, date.alias("bought_date"), price.alias("bought_price"), F.year(date).alias("bought_year"))


def _paired_whole(sales: DataFrame) -> DataFrame:
    """A window over each property."""
    own = Window.partitionBy("property_id").orderBy("sale_date", "price", F.col("transaction_id").asc_nulls_first())
    last = sales.withColumn("_last", F.lag(F.struct("sale_date", "price")).over(own))
    return _bought(last, sales.columns, F.col("_last.sale_date"), F.col("_last.price"))


def _paired_in_parts(sales: DataFrame) -> DataFrame:
    """No window larger than a part, or than the parts of a property."""
    part = [*PD, "_band"]
    inside = Window.partitionBy(*part).orderBy(F.col("price"), F.col("transaction_id").asc_nulls_first())
    paired = sales.withColumn("_band", _band(F.col("price"))).withColumns(
        {"_previous": F.lag("price").over(inside), "_more": F.lead(F.lit(1)).over(inside)})
    ends = paired.where(F.col("_more").isNull()).select(*part, F.struct(F.col("sale_date").alias("d"), F.col("price").alias("p")).alias("end"))
    parts = Window.partitionBy("property_id").orderBy("sale_date", "_band")
    carried = ends.select(*part, F.lag("end").over(parts).alias("_carried"))
    both = paired.join(carried, part)
    first = F.col("_previous").isNull()
    return _bought(both, sales.columns, F.when(first, F.col("_carried.d")).otherwise(F.col("sale_date")),
                   F.when(first, F.col("_carried.p")).otherwise(F.col("_previous")))


def hot_properties(sales: DataFrame, hot_sales: int = HOT_SALES) -> DataFrame:
    """Ids of the properties with over ``hot_sales`` sales, the
    ``HOT_PROPERTIES`` hottest at most."""
    counts = sales.groupBy(F.col("property_id").alias("_hot_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > hot_sales).orderBy(F.desc("n"), "_hot_id").limit(HOT_PROPERTIES).select("_hot_id")


def _by_heat(sales: DataFrame, hot_sales: int) -> tuple[DataFrame, DataFrame]:
    """The sales of all other properties, and those of the hot ones."""
    # bounded by its limit, whatever the sales
    hot = F.broadcast(hot_properties(sales, hot_sales))
    is_hot = F.col("property_id") == F.col("_hot_id")
    return sales.join(hot, is_hot, "left_anti"), sales.join(hot, is_hot, "left_semi")


def with_predecessor(sales: DataFrame, hot_sales: int = HOT_SALES) -> DataFrame:
    """Add ``bought_date``, ``bought_price``, ``bought_year`` (null when the
    sale is the property's first)."""
    others, hot = _by_heat(sales, hot_sales)
    return _paired_whole(others).unionByName(_paired_in_parts(hot))


def placed_with_predecessor(sales: DataFrame, place: str, parts: int = 1, hot_sales: int = HOT_SALES) -> DataFrame:
    """``with_predecessor`` for a writer that wants the rows of a ``place`` (a
    column that depends on the property alone) together, sorted by place and
    property: dealt out by place, ``parts`` tasks to each, in the one exchange
    that the pairing needs. Hot properties come paired; their sales are spread
    over the tasks of their place by day, and pass the window unchanged."""
    others, hot = _by_heat(sales, hot_sales)
    mine = [c for c in sales.columns if c != "property_id"]
    found = F.struct(F.col("bought_date").alias("sale_date"), F.col("bought_price").alias("price"))
    paired = _paired_in_parts(hot).select("property_id", *mine, found.alias("_found"), F.col("sale_date").alias("_hot_day"))
    nothing = {c: F.lit(None).cast(paired.schema[c].dataType) for c in ("_found", "_hot_day")}
    rows = others.withColumns(nothing).unionByName(paired).withColumn("_part", F.pmod(F.hash("property_id", "_hot_day"), F.lit(parts)))
    own = Window.partitionBy(place, "property_id", "_hot_day", "_part").orderBy(
        "sale_date", "price", F.col("transaction_id").asc_nulls_first())
    last = F.when(F.col("_found").isNull(), F.lag(F.struct("sale_date", "price")).over(own)).otherwise(F.col("_found"))
    return _bought(rows.repartition(place, "_part").withColumn("_last", last), sales.columns, F.col("_last.sale_date"), F.col("_last.price"))


def with_appreciation(df: DataFrame) -> DataFrame:
    """``appreciation_pounds`` = sold - bought; ``appreciation_pct`` = that as
    percent of bought, null unless bought price > 0."""
    gain = F.col("price") - F.col("bought_price")
    return df.withColumn("appreciation_pounds", gain).withColumn(
        "appreciation_pct",
        F.when(F.col("bought_price") > 0, gain / F.col("bought_price") * 100),
    )


def repeat_sales(sales: DataFrame) -> DataFrame:
    """Sales that have a previous sale of the same property, with
    ``year_bought`` and appreciation columns. The later sale's segment
    attributes are kept."""
    paired = with_predecessor(sales).where(F.col("bought_date").isNotNull())
    return with_appreciation(paired.withColumn("year_bought", F.col("bought_year")))
