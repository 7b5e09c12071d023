"""CSV sources and sinks.

* ``read_raw_sales``: headerless positional sale file(s), every column a
  nullable string, no schema inference (missing trailing columns -> null).
* ``checked_sale_lines``: the same files line by line, with the lines marked
  that are no sale rows (more fields than columns, a quote left open).
* ``resolve_roles``: project any sale table onto the roles the cleaning step
  needs; the caller names the columns, or they are found by the words of
  their names.
* ``read_key_value_csv`` / ``write_key_value_csv``: the (key, value) export.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.schema import KEY_VALUE_SCHEMA, RAW_COLUMNS, RAW_SCHEMA

# Role -> the words that a column name must hold for it, most wanted first;
# a name that is one of the alternatives, word for word, beats any other.
ROLE_WORDS = {
    "price": [["price"]],
    "date": [["date", "transfer"], ["date"]],
    "postcode": [["postcode"]],
    "property_type": [["property", "type"]],
    "duration": [["duration"]],
    "county": [["county"]],
    "district": [["district"]],
    "paon": [["paon"]],
    "saon": [["saon"]],
    "street": [["street"]],
}
# address parts that may be missing; they default to ''
OPTIONAL_ROLES = {"paon", "saon", "street"}
# words that disqualify a column for a role
NOT_FOR = {"street": ["address"]}


def read_raw_sales(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Scan headerless sale CSV file(s) or folder(s) by position."""
    return spark.read.schema(RAW_SCHEMA).option("header", False).option("mode", "PERMISSIVE").csv(path)


def _open_quote(line: Column) -> Column:
    """An odd number of quotes, escaped ones aside."""
    bare = F.replace(line, F.lit('\\"'), F.lit(""))
    return (F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))) % 2 == 1


def _n_fields(line: Column) -> Column:
    """Fields of a line, commas inside quotes aside."""
    outside = F.regexp_replace(line, r'"(?:[^"\\\\]|\\\\.)*"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1


def checked_sale_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line of sale CSV file(s): the raw columns, the line's place
    (``LOAD_PLACE``), ``line`` and ``reject``: ``quotes`` for a quote left
    open, ``fields`` for more fields than columns, else null. Fewer fields
    are tolerated, as the raw scan does. A line is parsed once."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_pos"))
    schema = RAW_SCHEMA.simpleString()[len("struct<"):-1].replace(":", " ") + ", _bad string"
    parsed = lines.withColumn("row", F.from_csv("line", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}))
    # only lines whose number of fields is another are looked at again
    odd = F.col("row._bad").isNotNull()
    reject = F.when(_open_quote(F.col("line")), "quotes").when(odd & (_n_fields(F.col("line")) > len(RAW_COLUMNS)), "fields")
    return parsed.select(*[F.col(f"row.{c}").alias(c) for c in RAW_COLUMNS], *LOAD_PLACE, "line", reject.alias("reject"))


def checked_sales(lines: DataFrame) -> DataFrame:
    """The raw sales among ``checked_sale_lines``."""
    return lines.where("reject IS NULL").select(*RAW_COLUMNS)


def rejected_lines(lines: DataFrame) -> DataFrame:
    """The other lines: where they stand, the reason, and the text."""
    return lines.where("reject IS NOT NULL").select(*LOAD_PLACE, "reject", "line")


def match_role(role: str, columns: list[str]) -> str | None:
    """The column for a role, None if no name fits; several that fit equally
    well are an error, to be settled by naming one."""
    for words in ROLE_WORDS[role]:
        fits = [c for c in columns if all(w in c.lower() for w in words)
                and not any(w in c.lower() for w in NOT_FOR.get(role, []))]
        exact = [c for c in fits if c.lower() in (role, "_".join(words), "_of_".join(words))]
        if len(exact) == 1 or len(fits) == 1:
            return (exact or fits)[0]
        if fits:
            raise ValueError(f"role {role}: {fits} fit equally well; name one in roles=")
    return None


def resolve_roles(df: DataFrame, roles: dict[str, str] | None = None) -> DataFrame:
    """Project ``df`` onto the role columns (schema-time mapping, no data
    pass). ``roles`` names columns for roles; the others are matched by name.

    Adds ``transaction_id`` (null when absent) as the last tie-break key.
    Missing required roles raise; missing address parts become ''.
    """
    named = dict(roles or {})
    unknown = [r for r in named if r not in ROLE_WORDS] + [c for c in named.values() if c not in df.columns]
    if unknown:
        raise ValueError(f"no such role or column: {unknown}")
    found = {r: named.get(r) or match_role(r, df.columns) for r in ROLE_WORDS}
    missing = [r for r, c in found.items() if c is None and r not in OPTIONAL_ROLES]
    if missing:
        raise ValueError(f"no column fits the roles {missing}; name them in roles=")
    tid = F.col("transaction_id").cast("string") if "transaction_id" in df.columns else F.lit(None).cast("string")
    return df.select(tid.alias("transaction_id"), *[
        (F.lit("") if c is None else F.col(c).cast("string")).alias(r) for r, c in found.items()])


# A row's place in a load: files by path, blocks of a file by their start,
# rows of a block as they are read.
LOAD_PLACE = ["file_path", "block_start", "row_pos"]


def read_key_value_csv(spark: SparkSession, path: str | list[str], with_place: bool = False) -> DataFrame:
    """Read a (key, value) CSV export with a header; values may hold commas
    and escaped quotes, which a real CSV parser keeps intact. ``with_place``
    adds the columns ``LOAD_PLACE``."""
    rows = (
        spark.read.schema(KEY_VALUE_SCHEMA)
        .option("header", True)
        .option("escape", "\\")
        .option("multiLine", False)
        .csv(path)
    )
    if not with_place:
        return rows
    return rows.select(
        "key", "value", F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("row_pos"))


def write_key_value_csv(df: DataFrame, path: str) -> None:
    """Write (key, value) as CSV with a header, one file per task (no
    single-task funnel)."""
    df.select("key", "value").write.mode("overwrite").option("header", True).option(
        "escape", "\\"
    ).csv(path)
