"""Display labels of dimension values."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dimension_label(dimension: Column, value: Column) -> Column:
    """county/borough/tenure: title case; postcode: upper case; house type:
    '_' -> ' ' then title case; bands: the value itself."""
    return (
        F.when(dimension.isin("county", "borough", "tenure"), F.initcap(value))
        .when(dimension == "postcode", F.upper(value))
        .when(dimension == "house_type", F.initcap(F.regexp_replace(value, "_", " ")))
        .otherwise(value)
    )
