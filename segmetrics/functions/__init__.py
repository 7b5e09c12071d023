"""Column-expression helpers. Every function takes and returns ``Column``s,
so it stays inside whole-stage codegen (no Python UDFs)."""
from segmetrics.functions.text import (  # noqa: F401
    house_type,
    is_blank,
    normalise,
    normalise_or_empty,
    outcode,
    strip,
    tenure,
)
from segmetrics.functions.keys import (  # noqa: F401
    lookup_part,
    property_id,
    segment_key,
    split_key,
)
