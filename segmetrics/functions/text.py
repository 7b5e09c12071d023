"""Text cleaning of raw sale fields (native expressions).

"Whitespace" is exactly the set of characters for which Python's
``str.isspace()`` holds (ASCII blanks, the 0x1C-0x1F separators, no-break
space, the Unicode space separators...), built by that rule below. Stripping
uses ``btrim`` with that set; inner whitespace is mapped to ' ' with
``translate`` (a per-character table) and runs of blanks are collapsed with a
literal-prefix regex. Each function references its input once, but ``spaced``
and the ``*_of_spaced`` functions, which read columns.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmetrics.schema import (
    HOUSE_TYPE_DEFAULT,
    HOUSE_TYPES,
    TENURE_DEFAULT,
    TENURES,
    UNKNOWN,
)

# Rule: every code point Python counts as whitespace (all lie below U+3001).
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
_OTHER_BLANKS = WHITESPACE.replace(" ", "")
_AS_SPACES = " " * len(_OTHER_BLANKS)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove leading and trailing whitespace."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    """True for null, empty or whitespace-only text."""
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def _blanks_to_spaces(c: Column) -> Column:
    return F.translate(c, _OTHER_BLANKS, _AS_SPACES)


def _clean_stripped(s: Column) -> Column:
    # lower-case, drop '#', then collapse whitespace runs (input already
    # stripped); the order matters: "# a" keeps its leading blank, "#"
    # becomes "". Each input is referenced once, so the generated code stays
    # small enough for the JIT.
    return F.regexp_replace(_blanks_to_spaces(F.replace(F.lower(s), F.lit("#"), F.lit(""))), " {2,}", " ")


def _stripped_or_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def spaced(c: Column | str) -> Column:
    """The text with every whitespace character as a blank, stripped. As a
    column of its own it is the input of the ``*_of_spaced`` functions, which
    refer to it more than once. Printable ASCII has no blank but ' ', and is
    spared the per-character table."""
    c = _col(c)
    return F.trim(F.when(c.rlike("[^ -~]"), _blanks_to_spaces(c)).otherwise(c))


def _collapsed(x: Column) -> Column:
    return F.regexp_replace(F.replace(F.lower(x), F.lit("#"), F.lit("")), " {2,}", " ")


def normalise_of_spaced(x: Column | str) -> Column:
    """``normalise`` of a text, from its ``spaced`` form."""
    x = _col(x)
    return F.when(x != "", _collapsed(x)).otherwise(F.lit(UNKNOWN))


def normalise_or_empty_of_spaced(parts: dict[str, Column | str], delimiter: str) -> Column:
    """``normalise_or_empty`` of each text (name -> ``spaced`` form), joined.
    They are joined first and normalised together: a run of blanks doesn't
    cross the delimiter."""
    pieces = [F.when(_col(x) != "", _col(x)).when(F.col(c) != "", F.lit(UNKNOWN)).otherwise(F.lit("")) for c, x in parts.items()]
    return _collapsed(F.concat_ws(delimiter, *pieces))


def normalise(c: Column | str) -> Column:
    """Blank -> 'unknown'; otherwise strip, lower, remove '#', single blanks."""
    return F.coalesce(_clean_stripped(_stripped_or_null(_col(c))), F.lit(UNKNOWN))


def normalise_or_empty(c: Column | str) -> Column:
    """Null or '' -> ''; whitespace-only -> 'unknown'; else as ``normalise``."""
    c = _col(c)
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(normalise(c))


def _code_lookup(c: Column, mapping: dict[str, str], default: str) -> Column:
    # a blank or missing value has no first letter in the map -> default
    first = F.substring(F.lower(F.trim(_blanks_to_spaces(c))), 1, 1)
    pairs = []
    for code, name in mapping.items():
        pairs += [F.lit(code), F.lit(name)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), first), F.lit(default))


def house_type(c: Column | str) -> Column:
    """Property type code (first letter, any case) -> house type name."""
    return _code_lookup(_col(c), HOUSE_TYPES, HOUSE_TYPE_DEFAULT)


def tenure(c: Column | str) -> Column:
    """Duration code (first letter, any case) -> tenure name."""
    return _code_lookup(_col(c), TENURES, TENURE_DEFAULT)


def outcode_of_spaced(x: Column | str) -> Column:
    """``outcode`` of a postcode, from its ``spaced`` form."""
    x = _col(x)
    first = F.replace(F.lower(F.substring_index(x, " ", 1)), F.lit("#"), F.lit(""))
    return F.when(x != "", first).otherwise(F.lit(UNKNOWN))


def outcode(c: Column | str) -> Column:
    """Postcode -> outward code: first whitespace token, normalised."""
    token = F.substring_index(_blanks_to_spaces(_stripped_or_null(_col(c))), " ", 1)
    return F.coalesce(F.replace(F.lower(token), F.lit("#"), F.lit("")), F.lit(UNKNOWN))
