"""Readers: raw sale files, the driver-table adapter, serving tables."""
from segmetrics.sources.csv import (  # noqa: F401
    read_key_value_csv,
    read_raw_sales,
    resolve_roles,
    write_key_value_csv,
)
from segmetrics.sources.tables import raw_sales_from_tables, read_table  # noqa: F401
