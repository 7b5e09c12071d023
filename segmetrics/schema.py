"""Schemas and fixed vocabularies.

All values below must equal the ones the served data uses, so they are kept
together here as fixed values.
"""
from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

# --- fixed values -----------------------------------------------------------
# Raw sale file: positional columns, in file order.
RAW_COLUMNS = [
    "transaction_id",
    "price",
    "date_of_transfer",
    "postcode",
    "property_type",
    "old_new",
    "duration",
    "paon",
    "saon",
    "street",
    "locality",
    "town",
    "district",
    "county",
    "ppd_category_type",
    "record_status",
]

# First letter of the property type code -> house type.
HOUSE_TYPES = {
    "d": "detached",
    "s": "semi_detached",
    "t": "terraced",
    "f": "flat",
    "o": "other",
}
HOUSE_TYPE_DEFAULT = "other"

# First letter of the duration code -> tenure.
TENURES = {
    "f": "freehold",
    "l": "leasehold",
}
TENURE_DEFAULT = "unknown"

# Value used by normalisation for a missing text value.
UNKNOWN = "unknown"
# Value that stands for "every value" of a dimension in a segment key.
ALL = "all"
# Delimiters of the segment key and of the property id.
KEY_DELIMITER = "#"
PROPERTY_DELIMITER = "|"

# Location types and the cleaned sale column each one groups on.
LOCATION_LEVELS = [
    ("county", "county"),
    ("postcode", "outcode"),
    ("borough", "district"),
]
# Location types a request may name (street has no cube of its own).
REQUEST_LOCATION_TYPES = ["county", "postcode", "borough", "street"]

# Segment key parts, in key order.
KEY_COLUMNS = [
    "location_type",
    "location_value",
    "house_type",
    "tenure",
    "size_band",
    "year_built_band",
]

# Dimension names of the dimension index.
DIMENSIONS = [
    "county",
    "borough",
    "postcode",
    "house_type",
    "tenure",
    "size_band",
    "year_built_band",
    "year_bought_band",
]

# Heatmap metrics a grid view can show; an unknown name shows the default.
HEATMAP_METRICS = [
    "avg_appreciation_pounds",
    "median_appreciation_pounds",
    "sale_count",
    "avg_appreciation_pct",
    "median_appreciation_pct",
    "pct_sales_appreciated",
]
HEATMAP_METRIC_DEFAULT = "median_appreciation_pounds"
PCT_METRICS = {"avg_appreciation_pct", "median_appreciation_pct", "pct_sales_appreciated"}

# Grid year range of the heatmap view.
GRID_YEAR_MIN = 2005
GRID_YEAR_MAX = 2025

# Accuracy argument of the median (percentile_approx).
MEDIAN_ACCURACY = 10000
# --- end of fixed values ----------------------------------------------------

RAW_SCHEMA = StructType([StructField(c, StringType(), True) for c in RAW_COLUMNS])

KEY_VALUE_SCHEMA = StructType(
    [StructField("key", StringType(), True), StructField("value", StringType(), True)]
)

LINE_POINT = StructType(
    [
        StructField("year_sold", StringType(), True),
        StructField("avg_price", DoubleType(), True),
        StructField("median_price", DoubleType(), True),
        StructField("mode_price", DoubleType(), True),
        StructField("sale_count", LongType(), True),
    ]
)

HEATMAP_CELL = StructType(
    [
        StructField("year_bought", StringType(), True),
        StructField("year_sold", StringType(), True),
        StructField("avg_appreciation_pounds", DoubleType(), True),
        StructField("median_appreciation_pounds", DoubleType(), True),
        StructField("sale_count", LongType(), True),
        StructField("avg_appreciation_pct", DoubleType(), True),
        StructField("median_appreciation_pct", DoubleType(), True),
        StructField("pct_sales_appreciated", DoubleType(), True),
        StructField("biggest_loser_pounds", DoubleType(), True),
        StructField("biggest_loser_pct", DoubleType(), True),
        StructField("biggest_winner_pounds", DoubleType(), True),
        StructField("biggest_winner_pct", DoubleType(), True),
    ]
)

SERVED_CELL_FIELDS = HEATMAP_CELL.fieldNames()[:8]

PERFORMANCE_VALUE = StructType(
    [
        StructField("line_graph", ArrayType(LINE_POINT), True),
        StructField("heatmap_graph", ArrayType(HEATMAP_CELL), True),
        StructField("sale_count", LongType(), True),
    ]
)

DIMENSION_VALUE = StructType(
    [
        StructField("sk", StringType(), True),
        StructField("label", StringType(), True),
        StructField("sale_count", LongType(), True),
    ]
)

REQUEST_SCHEMA = StructType(
    [StructField("request_id", LongType(), True)]
    + [StructField(c, StringType(), True) for c in KEY_COLUMNS]
)
