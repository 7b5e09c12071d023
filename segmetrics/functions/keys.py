"""Property id, segment key and lookup-key expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmetrics.schema import ALL, KEY_COLUMNS, KEY_DELIMITER, PROPERTY_DELIMITER
from segmetrics.functions.text import normalise_or_empty, strip


def property_id(postcode: Column, paon: Column, saon: Column, street: Column) -> Column:
    """postcode|paon|saon|street, each part normalised ('' when missing)."""
    return F.concat_ws(
        PROPERTY_DELIMITER,
        *[normalise_or_empty(c) for c in (postcode, paon, saon, street)],
    )


def segment_key(*parts: Column | str) -> Column:
    """The '#'-joined six-part segment key (string form used at the edges)."""
    cols = parts or tuple(KEY_COLUMNS)
    return F.concat_ws(KEY_DELIMITER, *[F.col(c) if isinstance(c, str) else c for c in cols])


def split_key(key: Column | str, names: list[str] | None = None) -> list[Column]:
    """Split a segment key string back into its named parts."""
    key = F.col(key) if isinstance(key, str) else key
    parts = F.split(key, KEY_DELIMITER)
    return [parts.getItem(i).alias(n) for i, n in enumerate(names or KEY_COLUMNS)]


def lookup_part(c: Column | str, default_all: bool = True) -> Column:
    """Request-side normalisation: null or '' -> 'all', then strip + lower.

    Weaker than ``normalise`` on purpose: no '#' removal, no blank collapse.
    """
    c = F.col(c) if isinstance(c, str) else c
    if default_all:
        c = F.coalesce(F.nullif(c, F.lit("")), F.lit(ALL))
    return F.lower(strip(c))
