"""Loading (key, value) exports into the serving tables, and upserts.

Rows with a blank key or malformed JSON are rejected, not raised; dimension
rows also need a non-empty ``sk``.

An upsert reduces the load to the last row of each key, and takes the keys
that it holds out of the table with an anti join. The optimizer broadcasts
the load's keys where its estimate of them allows (the table is then read in
place, without an exchange) and shuffles both sides beyond.
"""
from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.functions.json import dimension_field, parsed_once, performance_field
from segmetrics.functions.keys import split_key
from segmetrics.functions.text import strip
from segmetrics.schema import HEATMAP_CELL, KEY_COLUMNS, LINE_POINT
from segmetrics.sources.csv import LOAD_PLACE

DIMENSION_KEYS = ["dimension_name", "value"]


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (strip(c) == "")


def _sequence(seq: Column | int | None) -> list[Column]:
    if seq is None:
        return []
    return [(F.lit(seq) if isinstance(seq, int) else seq).cast("long").alias("load_seq")]


def _parsed(kv: DataFrame) -> DataFrame:
    """(key, value) rows with the value parsed, once, as ``_v``."""
    return parsed_once(kv, "value", "_v")


def _performance_rows(parsed: DataFrame, seq: Column | int | None, keep: Sequence[str]) -> DataFrame:
    rows = parsed.where(~_blank("key") & F.col("_v").isNotNull()).select(
        strip("key").alias("_key"),
        *[performance_field("_v", f).alias(f) for f in ("line_graph", "heatmap_graph", "sale_count")], *_sequence(seq), *keep)
    rest = [c for c in rows.columns if c not in ("_key", "line_graph", "heatmap_graph", "sale_count")]
    return rows.select(
        *split_key("_key"),
        F.coalesce("line_graph", F.array().cast(f"array<{LINE_POINT.simpleString()}>")).alias("line_graph"),
        F.coalesce("heatmap_graph", F.array().cast(f"array<{HEATMAP_CELL.simpleString()}>")).alias("heatmap_graph"),
        "sale_count", *rest)


def parse_performance_kv(kv: DataFrame, seq: Column | int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key, value) text -> typed performance rows, and ``load_seq`` if
    ``seq`` is given; rejects dropped. Missing graphs default to empty arrays."""
    return _performance_rows(_parsed(kv), seq, keep)


def _dimension_rows(parsed: DataFrame, seq: Column | int | None, keep: Sequence[str]) -> DataFrame:
    rows = parsed.where(~_blank("key") & F.col("_v").isNotNull()).select(
        F.regexp_replace(strip("key"), "^meta#", "").alias("dimension_name"), dimension_field("_v", "sk").alias("value"),
        dimension_field("_v", "label").alias("label"), dimension_field("_v", "sale_count").alias("sale_count"),
        *_sequence(seq), *keep)
    return rows.where(F.coalesce("value", F.lit("")) != "")


def parse_dimension_kv(kv: DataFrame, seq: Column | int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(key 'meta#<dim>', value {sk, label}) -> (dimension_name, value,
    label, sale_count) and ``load_seq`` if ``seq`` is given; rows without sk
    are rejected."""
    return _dimension_rows(_parsed(kv), seq, keep)


def _report(require_sk: bool) -> list[Column]:
    """Counts over rows parsed as ``_v``."""
    blank = _blank("key")
    bad = ~blank & F.col("_v").isNull()
    no_sk = F.lit(False)
    if require_sk:
        no_sk = ~blank & ~bad & (F.coalesce(dimension_field("_v", "sk"), F.lit("")) == "")
    return [
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(blank).alias("blank_key"),
        F.count_if(bad).alias("malformed"),
        F.count_if(no_sk).alias("missing_sk"),
        F.count_if(~blank & ~bad & ~no_sk).alias("loaded"),
    ]


def load_report(kv: DataFrame, require_sk: bool = False) -> DataFrame:
    """One-row report: rows read, blank keys, malformed values, loaded."""
    return _parsed(kv).agg(*_report(require_sk))


def observed_load(kv: DataFrame, kind: str = "performance", seq: Column | int | None = None, keep: Sequence[str] = ()):
    """Parse a (key, value) load and count rows read / rejected *in the same
    pass* that writes it: returns (rows, Observation); the observation is
    filled when the first action on ``rows`` completes."""
    from pyspark.sql import Observation

    obs = Observation(f"{kind}_load")
    observed = _parsed(kv).observe(obs, *_report(kind != "performance"))
    rows = _performance_rows if kind == "performance" else _dimension_rows
    return rows(observed, seq, keep), obs


def last_of_load(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; rows that tie there are told
    apart by a hash of their content, so the result never depends on how the
    rows are laid out. ``order`` columns other than a sequence are dropped."""
    cols = [c for c in rows.columns if c not in keys]
    place = F.struct(*order, F.xxhash64(*rows.columns).alias("_content"))
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*cols), place).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in cols if c not in LOAD_PLACE])


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], seq: str = "load_seq") -> DataFrame:
    """The table after the load: the load's last row of each of its keys, and
    the table's rows of all other keys.

    Rows of a load are ordered by ``seq`` if they carry it, then by their
    place in the files (``LOAD_PLACE``) if they carry that. If the table and
    the load both carry ``seq``, a table row with a greater one stays; if
    neither does, the load wins. One side alone is an error: it cannot be
    told which row is newer."""
    if (seq in existing.columns) != (seq in incoming.columns):
        raise ValueError(f"'{seq}' must be in both, the table and the load, or in neither")
    order = [c for c in [seq, *LOAD_PLACE] if c in incoming.columns]
    latest = last_of_load(incoming, keys, order).select(*existing.columns)
    n = {k: F.col(f"n.{k}").eqNullSafe(F.col(f"t.{k}")) for k in keys}
    same = None
    for c in n.values():
        same = c if same is None else same & c
    load_keys = latest.select(*keys, *([seq] if seq in existing.columns else [])).alias("n")
    if seq not in existing.columns:
        return existing.alias("t").join(load_keys, same, "left_anti").unionByName(latest)
    stays = F.col(f"t.{seq}") > F.col(f"n.{seq}")
    kept = existing.alias("t").join(load_keys, same & ~F.coalesce(stays, F.lit(False)), "left_anti")
    newer = existing.select(*keys, seq).alias("t").join(load_keys, same & stays).select(*[F.col(f"t.{k}") for k in keys])
    match = None
    for k in keys:
        c = F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}"))
        match = c if match is None else match & c
    return kept.unionByName(latest.alias("l").join(newer.alias("o"), match, "left_anti"))


def latest(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Current view of an append-only change table: last row per key."""
    return last_of_load(rows, keys, seq).drop(*seq)


def upsert_performance(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, KEY_COLUMNS)


def upsert_dimension(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert(existing, incoming, DIMENSION_KEYS)
