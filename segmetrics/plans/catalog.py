"""The registered queries: each takes (spark, sf_dir), reads the driver
tables under ``sf_dir`` and returns a DataFrame of flat columns (arrays are
exploded with their position, dates printed as yyyy-MM-dd) so results can
be compared with a SQL engine.

Means of non-integer values (percent metrics, weighted merges) depend on
summation order in the last bits; those columns are reported rounded to 6
decimals (``REPORT_DIGITS``). Everything else is reported as computed.
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmetrics.config import scratch_path, sparing_disk, stored
from segmetrics.functions.json import dimension_to_json, performance_to_json
from segmetrics.functions.keys import segment_key, split_key
from segmetrics.functions.text import house_type, normalise, normalise_of_spaced, normalise_or_empty, outcode, tenure
from segmetrics.functions.keys import property_id as property_id_expr
from segmetrics.operators.aggregates import line_metrics_from_partials, line_partials
from segmetrics.operators import extras
from segmetrics.operators.clean import (
    borough_predicate,
    clean_sales,
    kept_rows,
    parse_price_date,
    rejected_sales,
    reserved,
    reserved_value_report,
    segment_columns,
)
from segmetrics.operators.cube import affected_keys, location_fanout, segment_cube, segment_cube_gs
from segmetrics.operators.dimensions import dimension_index, list_dimension
from segmetrics.operators.merge import merge_heatmap, merge_line
from segmetrics.operators.repeat import repeat_sales
from segmetrics.operators.series import heatmap_series, line_series, performance_table
from segmetrics.operators.upsert import (
    load_report,
    parse_dimension_kv,
    parse_performance_kv,
    upsert_dimension,
    upsert_performance,
)
from segmetrics.operators.views import heatmap_grid, metric_long, metric_range, metric_scaled
from segmetrics.plans.build import (
    LINE_INPUT,
    heatmap_agg,
    line_agg,
    performance_from_sales,
    performance_from_shared,
    shared_sales,
)
from segmetrics.plans.serve import (
    list_performance,
    query_heatmap,
    query_line,
    rejected_requests,
    segment_in,
    served_shape,
    validate_requests,
)
from segmetrics.plans.adhoc import adhoc_line, store_aggregates
from segmetrics.plans.increments import add_to_line, add_to_pairs, line_from_states
from segmetrics.schema import HEATMAP_CELL, KEY_COLUMNS, RAW_COLUMNS, SERVED_CELL_FIELDS
from segmetrics.sources.csv import (
    checked_sale_lines,
    checked_sales,
    read_key_value_csv,
    read_raw_sales,
    rejected_lines,
    resolve_roles,
    write_key_value_csv,
)
from segmetrics.operators.joins import join_dimension
from segmetrics.plans.load import apply_load, load_export, read_current
from segmetrics.sources.buckets import Version, write_version
from segmetrics.sources.tables import raw_sales_from_tables, read_table, spread

REPORT_DIGITS = 6
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

# Years covered by the driver tables; the grid query shows these.
DATA_YEARS = [str(y) for y in range(1995, 2002)]
# Cut-over year of the incremental-load queries: a first build sees the
# sales shipped before it, the second build all sales.
SNAPSHOT_YEAR = 2000


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _r(c: str) -> F.Column:
    return F.round(F.col(c), REPORT_DIGITS).alias(c)


def _date(c: str) -> F.Column:
    return F.date_format(F.col(c), "yyyy-MM-dd").alias(c)


# --- shared inputs -----------------------------------------------------------

def raw(spark, sf):
    return raw_sales_from_tables(spark, sf)


def sales(spark, sf):
    return clean_sales(raw(spark, sf))


def shared(spark, sf):
    """Clean sales, partitioned for the repeat pairing and checkpointed."""
    return shared_sales(sales(spark, sf))


def repeats(spark, sf):
    return repeat_sales(shared(spark, sf))


def perf_from(s: DataFrame) -> DataFrame:
    return performance_from_sales(s)


def perf(spark, sf):
    return perf_from(sales(spark, sf))


def requests(spark, sf) -> DataFrame:
    """One request per customer: a location from the customer's nation,
    region or a postcode district, filters in mixed case / blank / missing;
    some requests are invalid on purpose (unknown type, empty value)."""
    c = spread(read_table(spark, sf, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    n = read_table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    df = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("c_custkey")
    loc_type = (
        F.when(k % 11 == 0, "city").when(k % 3 == 0, "county").when(k % 3 == 1, "borough").otherwise("postcode")
    )
    loc_value = (
        F.when(k % 13 == 0, F.lit(""))
        .when(k % 3 == 0, F.col("r_name"))
        .when(k % 3 == 1, F.concat(F.lit(" "), F.col("n_name"), F.lit(" ")))
        .otherwise(F.concat(F.lit("E"), (k % 50).cast("string")))
    )
    house = (
        F.when(k % 5 == 0, "Detached").when(k % 5 == 1, "").when(k % 5 == 2, " FLAT")
        .when(k % 5 == 3, F.lit(None).cast("string")).otherwise("semi_detached")
    )
    ten = (
        F.when(k % 4 == 0, "Freehold").when(k % 4 == 1, "all").when(k % 4 == 2, F.lit(None).cast("string"))
        .otherwise("LEASEHOLD ")
    )
    return df.select(
        k.alias("request_id"),
        loc_type.alias("location_type"),
        loc_value.alias("location_value"),
        house.alias("house_type"),
        ten.alias("tenure"),
        F.lit(None).cast("string").alias("size_band"),
        F.lit("ALL").alias("year_built_band"),
    )


def region_items(spark, sf, p: DataFrame) -> DataFrame:
    """Borough roll-up items (house type and tenure 'all') grouped by the
    region their nation belongs to: several items per group to merge."""
    n = read_table(spark, sf, "nation").select("n_name", "n_regionkey")
    r = read_table(spark, sf, "region").select("r_regionkey", "r_name")
    nr = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lower("n_name").alias("location_value"), F.lower("r_name").alias("region")
    )
    boroughs = served_shape(p).where(
        (F.col("location_type") == "borough") & (F.col("house_type") == "all") & (F.col("tenure") == "all")
    )
    return boroughs.join(nr, "location_value")


def _flat_line(p: DataFrame) -> DataFrame:
    return p.select(*KEY_COLUMNS, "sale_count", F.posexplode("line_graph").alias("pos", "pt")).select(
        *KEY_COLUMNS,
        "pos",
        F.col("pt.year_sold").alias("year_sold"),
        F.col("pt.avg_price").alias("avg_price"),
        F.col("pt.median_price").alias("median_price"),
        F.col("pt.mode_price").alias("mode_price"),
        F.col("pt.sale_count").alias("sale_count"),
        F.col("sale_count").alias("total_sale_count"),
    )


LINE_VALUES = ["avg_price", "median_price", "mode_price"]
CELL_VALUES = [f.name for f in HEATMAP_CELL.fields if f.name not in ("year_bought", "year_sold", "sale_count")]


def _payload(p: DataFrame, keys=KEY_COLUMNS, digits: int = REPORT_DIGITS) -> DataFrame:
    """Everything that a performance table holds, one row per line point
    (``kind`` line) and heatmap cell (``kind`` cell)."""
    def rows(kind, series, fields):
        x = p.select(*keys, F.col("sale_count").alias("total_sale_count"), F.explode(series).alias("x"))
        year = F.col("x.year_bought") if kind == "cell" else F.lit(None).cast("string")
        values = [F.round(F.col(f"x.{v}"), digits) if v in fields else F.lit(None).cast("double") for v in [*LINE_VALUES, *CELL_VALUES]]
        return x.select(*keys, "total_sale_count", F.lit(kind).alias("kind"), year.alias("year_bought"), "x.year_sold",
                        "x.sale_count", *[c.alias(v) for c, v in zip(values, [*LINE_VALUES, *CELL_VALUES])])

    return rows("line", "line_graph", LINE_VALUES).unionByName(rows("cell", "heatmap_graph", CELL_VALUES))


# --- sources / sinks ---------------------------------------------------------

@query("scan_csv")
def q_scan_csv(spark, sf):
    path = scratch_path(spark, "raw_sales_csv")
    # keep padding as written: the sale file is the data
    raw(spark, sf).write.mode("overwrite").option("header", False).option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return read_raw_sales(spark, path)


@query("csv_rejects")
def q_csv_rejects(spark, sf):
    """Sale lines with the faults that lines have: fields too many, a quote
    left open; and such as are fine: fields missing at the end, a comma
    inside quotes. Every line with its reason, and what was parsed of it."""
    o = F.split("transaction_id", "-")[0].cast("long")
    columns = [F.coalesce(c, F.lit("")) for c in RAW_COLUMNS]
    street = RAW_COLUMNS.index("street")
    quoted = [F.concat(F.lit('"'), c, F.lit(', x"')) if i == street else c for i, c in enumerate(columns)]
    line = F.when(o % 17 == 0, F.concat_ws(",", *columns, F.lit("x"), F.lit("y"))).when(
        o % 19 == 0, F.concat(columns[0], F.lit(',"'), F.concat_ws(",", *columns[1:]))).when(
        o % 23 == 0, F.concat_ws(",", *columns[:14])).when(o % 29 == 0, F.concat_ws(",", *quoted)).otherwise(F.concat_ws(",", *columns))
    path = scratch_path(spark, "sale_lines")
    raw(spark, sf).select(line.alias("value")).write.text(path)
    lines = checked_sale_lines(spark, path)
    good = checked_sales(lines).select("transaction_id", F.lit(None).cast("string").alias("reject"), "street", "record_status")
    bad = rejected_lines(lines).select(F.split("line", ",")[0].alias("transaction_id"), "reject",
                                       F.lit(None).cast("string").alias("street"), F.lit(None).cast("string").alias("record_status"))
    return good.unionByName(bad)


@query("resolve_roles")
def q_resolve_roles(spark, sf):
    return resolve_roles(raw(spark, sf))


@query("write_read_parquet")
def q_write_read_parquet(spark, sf):
    path = scratch_path(spark, "performance")
    perf(spark, sf).write.mode("overwrite").partitionBy("location_type").parquet(path)
    return _payload(spark.read.parquet(path))


@query("export_json")
def q_export_json(spark, sf):
    """The whole exported text, with every number and year as written."""
    return performance_to_json(perf(spark, sf)).select("key", F.col("value").alias("text"))


@query("import_json")
def q_import_json(spark, sf):
    kv = performance_to_json(perf(spark, sf))
    return _payload(parse_performance_kv(kv))


@query("roundtrip_csv")
def q_roundtrip_csv(spark, sf):
    path = scratch_path(spark, "performance_csv")
    write_key_value_csv(performance_to_json(perf(spark, sf)), path)
    return _payload(parse_performance_kv(read_key_value_csv(spark, path)))


TABLE_BUCKETS = 16
# Keys whose count is a multiple of it are not in the second load.
LEFT_ALONE = 4


def _loads(spark, sf, kind: str) -> DataFrame:
    """A first load and a second one through the batch loader. The first
    holds the table of the sales before the cut-over year; the second the
    keys of the full table whose count is no multiple of ``LEFT_ALONE``, in
    two files: rows with wrong counts first, then the right ones, and
    between them rows that must be rejected. So some keys are only in the
    table, some only in the load."""
    s = shared(spark, sf)
    before = performance_from_shared(s.where(F.col("year_sold") < SNAPSHOT_YEAR))
    full = stored(performance_from_shared(s), "full")
    to_index = (lambda p: p) if kind == "performance" else dimension_index
    to_kv = performance_to_json if kind == "performance" else dimension_to_json
    first, second, table = (scratch_path(spark, n) for n in ("load-1", "load-2", f"table-{kind}"))
    write_key_value_csv(to_kv(to_index(before)), first)
    loaded = stored(to_index(full).where(F.coalesce("sale_count", F.lit(1)) % LEFT_ALONE != 0), "loaded")
    right = to_kv(loaded)
    rejects = right.select(F.when(F.hash("key") % 2 == 0, F.lit(" ")).otherwise(F.col("key")).alias("key"),
                           F.lit("{not json").alias("value"))
    write_key_value_csv(to_kv(loaded.withColumn("sale_count", F.col("sale_count") + 1)), f"{second}/a")
    write_key_value_csv(rejects, f"{second}/b")
    write_key_value_csv(right, f"{second}/c")
    load_export(spark, first, table, kind, TABLE_BUCKETS)
    load_export(spark, [f"{second}/{x}" for x in "abc"], table, kind)
    return read_current(spark, table)


@query("upsert_performance")
def q_upsert_performance(spark, sf):
    """Last write wins, by file and row, over repeated keys and rejects."""
    return _payload(_loads(spark, sf, "performance"))


@query("upsert_sequence")
def q_upsert_sequence(spark, sf):
    """Table and load both carry sequences: of each key the greater stays.
    Keys with an odd sale count have the older row in the load; every third
    count is only in the load, every fifth only in the table."""
    full = stored(perf(spark, sf), "full")
    odd = F.col("sale_count") % 2 == 1
    table = full.where("sale_count % 3 != 0").withColumn("load_seq", F.lit(5).cast("long"))
    load = full.where("sale_count % 5 != 0").withColumn("load_seq", F.when(odd, 4).otherwise(6).cast("long")).withColumn(
        "sale_count", -F.col("sale_count"))
    return upsert_performance(table, load.unionByName(load.withColumn("load_seq", F.col("load_seq") - 3))).select(
        *KEY_COLUMNS, "sale_count", "load_seq")


@query("upsert_dimension")
def q_upsert_dimension(spark, sf):
    return _loads(spark, sf, "dimension").select("dimension_name", "value", "label", "sale_count")


def bucketed(spark, sf) -> Version:
    """The performance table as a bucketed table."""
    return write_version(perf(spark, sf), scratch_path(spark, "table"), KEY_COLUMNS, TABLE_BUCKETS)


@query("upsert_touched")
def q_upsert_touched(spark, sf):
    """A load of one segment's keys into a bucketed table, and which of the
    table's files are of the new version: those of the load's buckets."""
    table = bucketed(spark, sf)
    rows = table.read(spark).drop("bucket")
    mine = rows.where((F.col("location_type") == "borough") & (F.col("location_value") == "nation_3") & (F.col("house_type") == "flat"))
    after, _ = apply_load(stored(mine.withColumn("sale_count", -F.col("sale_count")), "load"), table.table, KEY_COLUMNS)
    now = after.read(spark)
    new_file = F.col("_metadata.file_path").contains(f"version={after.number:06d}")
    own = F.max((F.col("sale_count") < 0).cast("int")).over(Window.partitionBy("bucket"))
    # of every row: it lies in a new file if and only if its bucket was loaded
    return now.withColumn("new_file", new_file).withColumn("own", own).select(
        *KEY_COLUMNS, "sale_count", (F.col("new_file") == (F.col("own") == 1)).cast("int").alias("file_ok"))


def _dirty_load(p: DataFrame) -> DataFrame:
    """The table's export as a load with rejects: every 7th sale count's key
    blank, every 5th value cut short, every 3rd without ``sk``."""
    n = F.col("sale_count")
    idx = dimension_index(p)
    kv = dimension_to_json(idx.withColumn("value", F.when(n % 3 == 0, "").otherwise(F.col("value")))
                           .withColumn("sale_count", n))
    count = F.get_json_object("value", "$.sale_count").cast("long")
    return kv.select(
        F.when(count % 7 == 0, F.lit("\u00a0 ")).otherwise(F.col("key")).alias("key"),
        F.when(count % 5 == 0, F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value"))


@query("load_report")
def q_load_report(spark, sf):
    return load_report(_dirty_load(perf(spark, sf)), require_sk=True)


@query("load_dirty")
def q_load_dirty(spark, sf):
    """What such a load brings into the dimension index."""
    return parse_dimension_kv(_dirty_load(perf(spark, sf)))


# --- dirty sales --------------------------------------------------------------

def dirty_raw(spark, sf) -> DataFrame:
    """The raw sales with the faults that files have: prices and dates that
    don't parse, prices of zero and beyond all numbers, blanks, and values that read 'All'. Line
    and order numbers decide, so that SQL can repeat it."""
    ids = F.split("transaction_id", "-")
    o, n = ids[0].cast("long"), ids[1].cast("long")
    changed = {
        "price": F.when(o % 17 == 0, "n/a").when(o % 19 == 0, "12,500").when(o % 13 == 0, " 0 ").when(
            o % 59 == 0, "Infinity").when(o % 61 == 0, "1e999").otherwise(F.col("price")),
        "date_of_transfer": F.when(o % 23 == 0, "1996-02-31 00:00").when(o % 29 == 0, "").otherwise(F.col("date_of_transfer")),
        "county": F.when(o % 31 == 0, " All ").when(o % 37 == 0, "  ").otherwise(F.col("county")),
        "district": F.when((o % 41 == 0) & (n % 2 == 0), "ALL").otherwise(F.col("district")),
        "postcode": F.when(o % 43 == 0, "").otherwise(F.col("postcode")),
        "property_type": F.when(o % 47 == 0, "").otherwise(F.col("property_type")),
        "duration": F.when(o % 53 == 0, F.lit(None)).otherwise(F.col("duration")),
    }
    return raw(spark, sf).withColumns(changed)


@query("dirty_sales")
def q_dirty_sales(spark, sf):
    return clean_sales(dirty_raw(spark, sf)).select(*SALE_OUT, _date("sale_date"))


@query("dirty_rejects")
def q_dirty_rejects(spark, sf):
    return rejected_sales(dirty_raw(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


@query("dirty_performance")
def q_dirty_performance(spark, sf):
    """The whole table from dirty sales: reserved values counted nowhere, a
    null percentage where the bought price is zero."""
    return _payload(perf_from(clean_sales(dirty_raw(spark, sf))))


@query("dirty_grid")
def q_dirty_grid(spark, sf):
    p = perf_from(clean_sales(dirty_raw(spark, sf)))
    return heatmap_grid(served_shape(p), "median_appreciation_pct", DATA_YEARS)


# --- projections / scalar functions ------------------------------------------

SALE_OUT = ["transaction_id", "property_id", "price", "year_sold", "county", "outcode", "district",
            "house_type", "tenure"]


@query("clean_sales")
def q_clean_sales(spark, sf):
    return sales(spark, sf).select(*SALE_OUT, _date("sale_date"))


@query("reserved_values")
def q_reserved_values(spark, sf):
    return reserved_value_report(clean_sales(dirty_raw(spark, sf), keep_reserved=True))


@query("prefilter_borough")
def q_prefilter_borough(spark, sf):
    return clean_sales(raw(spark, sf), borough_predicate("NATION_7")).select(*SALE_OUT, _date("sale_date"))


@query("segment_columns")
def q_segment_columns(spark, sf):
    return sales(spark, sf).select(
        "transaction_id", "county", "outcode", "district", "house_type", "tenure",
        F.lit("all").alias("size_band"), F.lit("all").alias("year_built_band"),
    )


@query("f_normalise")
def q_f_normalise(spark, sf):
    r = raw(spark, sf)
    return r.select(
        "transaction_id",
        normalise("county").alias("county"),
        normalise("district").alias("district"),
        normalise("street").alias("street"),
        normalise("saon").alias("saon"),
        normalise_or_empty("saon").alias("saon_or_empty"),
    )


@query("property_id")
def q_property_id(spark, sf):
    r = raw(spark, sf)
    return r.select("transaction_id", property_id_expr(F.col("postcode"), F.col("paon"), F.col("saon"), F.col("street")).alias("property_id"))


@query("f_house_type")
def q_f_house_type(spark, sf):
    return raw(spark, sf).select("transaction_id", "property_type", house_type("property_type").alias("house_type"))


@query("f_tenure")
def q_f_tenure(spark, sf):
    return raw(spark, sf).select("transaction_id", "duration", tenure("duration").alias("tenure"))


@query("f_outcode")
def q_f_outcode(spark, sf):
    return raw(spark, sf).select("transaction_id", "postcode", outcode("postcode").alias("outcode"))


@query("segment_key")
def q_segment_key(spark, sf):
    return perf(spark, sf).select(segment_key().alias("key"), F.col("sale_count"))


@query("split_key")
def q_split_key(spark, sf):
    keyed = perf(spark, sf).select(segment_key().alias("key"), "sale_count")
    return keyed.select(*split_key("key"), "sale_count")


# --- repeat sales --------------------------------------------------------------

@query("repeat_sales")
def q_repeat_sales(spark, sf):
    return repeats(spark, sf).select(
        "transaction_id", "property_id", "price", "bought_price", "year_bought", "year_sold",
        _date("sale_date"), _date("bought_date"),
    )


@query("pairs_in_loads")
def q_pairs_in_loads(spark, sf):
    """The pairing of sales that come in three loads, the years in the middle
    last, in a table that is repaired load by load."""
    with sparing_disk(spark):
        s, path = shared(spark, sf), scratch_path(spark, "pairs")
    for part in ("year_sold < 1997", "year_sold >= 2000", "year_sold BETWEEN 1997 AND 1999"):
        now = add_to_pairs(s.where(part), path, TABLE_BUCKETS)
    return now.read(spark).where("bought_date IS NOT NULL").select(
        "transaction_id", "property_id", "price", "bought_price", F.col("bought_year").alias("year_bought"), "year_sold",
        _date("sale_date"), _date("bought_date"))


@query("appreciation")
def q_appreciation(spark, sf):
    return repeats(spark, sf).select("transaction_id", "appreciation_pounds", "appreciation_pct")


# --- cube ---------------------------------------------------------------------

@query("location_fanout")
def q_location_fanout(spark, sf):
    return location_fanout(sales(spark, sf)).select("transaction_id", "location_type", "location_value")


def finest_line(spark, sf) -> DataFrame:
    """Sums and counts of the prices by locations, dimensions and year: what
    the cube expands in place of every sale."""
    s = sales(spark, sf).select(*LINE_INPUT)
    return s.groupBy(*[c for c in LINE_INPUT if c != "price"]).agg(*line_partials())


@query("segment_cube")
def q_segment_cube(spark, sf):
    return segment_cube(finest_line(spark, sf), line_metrics_from_partials(), by=["year_sold"])


@query("segment_cube_gs")
def q_segment_cube_gs(spark, sf):
    return segment_cube_gs(finest_line(spark, sf), line_metrics_from_partials(), by=["year_sold"])


@query("affected_keys")
def q_affected_keys(spark, sf):
    segs = location_fanout(sales(spark, sf)).select(
        "location_type", "location_value", "house_type", "tenure",
        F.lit("all").alias("size_band"), F.lit("all").alias("year_built_band"),
    ).distinct()
    return affected_keys(segs)


# --- aggregates ---------------------------------------------------------------

@query("line_agg")
def q_line_agg(spark, sf):
    return line_agg(sales(spark, sf))


@query("incremental_line")
def q_incremental_line(spark, sf):
    """The line cube of sales that come in three loads: stored states, to
    which each load's own cube is added."""
    s, path = shared(spark, sf), scratch_path(spark, "line-states")
    later = F.col("year_sold") >= SNAPSHOT_YEAR
    for part in (~later, later & (F.col("district") == "nation_3"), later & (F.col("district") != "nation_3")):
        now = add_to_line(s.where(part), path, buckets=TABLE_BUCKETS)
    return line_from_states(now.read(spark))


HEAT_OUT = ["avg_appreciation_pounds", "median_appreciation_pounds", "sale_count", "median_appreciation_pct",
            "pct_sales_appreciated", "biggest_loser_pounds", "biggest_loser_pct", "biggest_winner_pounds",
            "biggest_winner_pct"]


@query("heatmap_agg")
def q_heatmap_agg(spark, sf):
    h = heatmap_agg(repeats(spark, sf))
    return h.select(*KEY_COLUMNS, "year_bought", "year_sold", *HEAT_OUT, _r("avg_appreciation_pct"))


@query("line_series")
def q_line_series(spark, sf):
    return _flat_line(line_series(line_agg(sales(spark, sf))))


@query("heatmap_series")
def q_heatmap_series(spark, sf):
    hs = heatmap_series(heatmap_agg(repeats(spark, sf)))
    cells = hs.select(*KEY_COLUMNS, F.posexplode("heatmap_graph").alias("pos", "c")).select(*KEY_COLUMNS, "pos", "c.*")
    return cells.select(*KEY_COLUMNS, "pos", "year_bought", "year_sold", *HEAT_OUT, _r("avg_appreciation_pct"))


@query("performance_table")
def q_performance_table(spark, sf):
    return _payload(perf(spark, sf))


@query("performance_join")
def q_performance_join(spark, sf):
    """J1 as a join: line series left-joined with heatmap series."""
    sh = shared(spark, sf)
    return _payload(performance_table(line_series(line_agg(sh)), heatmap_series(heatmap_agg(repeat_sales(sh)))))


@query("dimension_index")
def q_dimension_index(spark, sf):
    return dimension_index(perf(spark, sf))


@query("list_dimension")
def q_list_dimension(spark, sf):
    return list_dimension(dimension_index(perf(spark, sf)), "borough")


# --- serving ------------------------------------------------------------------

@query("lookup_segment")
def q_lookup_segment(spark, sf):
    return _flat_line(segment_in(spark, bucketed(spark, sf), "county", " EUROPE "))


SERVED_OUT = [f for f in SERVED_CELL_FIELDS if f != "avg_appreciation_pct"]


@query("served_shape")
def q_served_shape(spark, sf):
    p = served_shape(perf(spark, sf))
    cells = p.select(*KEY_COLUMNS, F.explode("heatmap_graph").alias("c")).select(*KEY_COLUMNS, "c.*")
    return cells.select(*KEY_COLUMNS, *SERVED_OUT, _r("avg_appreciation_pct"))


@query("validate_requests")
def q_validate_requests(spark, sf):
    v = validate_requests(requests(spark, sf))
    return v.select("request_id", F.col("valid").cast("int").alias("valid"), "reason")


@query("lookup_batch")
def q_lookup_batch(spark, sf):
    """Every request's items whole: a row for the answer, and one for each
    line point and heatmap cell that it holds."""
    table = bucketed(spark, sf)
    answers = list_performance(table.read(spark), requests(spark, sf), table.buckets)
    lp = stored(answers.withColumn("match_count", F.col("count").cast("bigint")).drop("count"), "answers")
    cell_values = [f for f in SERVED_CELL_FIELDS if f not in ("year_bought", "year_sold", "sale_count")]
    item = lp.select("request_id", "match_count", F.explode("items").alias("item"))

    def rows(kind, df, x, own):
        year = F.col("x.year_bought") if kind == "cell" else F.lit(None).cast("string")
        sold = F.lit(None).cast("string") if kind == "answer" else F.col("x.year_sold")
        return df.select("request_id", "match_count", F.lit(kind).alias("kind"), year.alias("year_bought"), sold.alias("year_sold"),
                         x.alias("sale_count"), *[(F.round(f"x.{v}", REPORT_DIGITS) if v in own else F.lit(None).cast("double")).alias(v)
                                                  for v in [*LINE_VALUES, *cell_values]])

    each = lambda series: item.select("request_id", "match_count", F.explode(f"item.{series}").alias("x"))
    total = F.try_element_at("items", F.lit(1))["sale_count"]
    return rows("answer", lp, total, []).unionByName(rows("line", each("line_graph"), F.col("x.sale_count"), LINE_VALUES)).unionByName(
        rows("cell", each("heatmap_graph"), F.col("x.sale_count"), cell_values))


@query("rejected_requests")
def q_rejected_requests(spark, sf):
    return rejected_requests(requests(spark, sf)).select("request_id", "reason")


@query("query_line")
def q_query_line(spark, sf):
    return query_line(stored(perf(spark, sf), "performance"), requests(spark, sf)).select(
        "request_id", "year_sold", "sale_count", _r("avg_price"), _r("median_price"), _r("mode_price")
    )


MERGED_HEAT = ["avg_appreciation_pounds", "median_appreciation_pounds", "avg_appreciation_pct",
               "median_appreciation_pct", "pct_sales_appreciated"]


@query("query_heatmap")
def q_query_heatmap(spark, sf):
    q = query_heatmap(stored(perf(spark, sf), "performance"), requests(spark, sf))
    return q.select("request_id", "year_bought", "year_sold", "sale_count", *[_r(c) for c in MERGED_HEAT])


@query("merge_line")
def q_merge_line(spark, sf):
    m = merge_line(region_items(spark, sf, stored(perf(spark, sf), "performance")), "region")
    return m.select("region", "year_sold", "sale_count", _r("avg_price"), _r("median_price"), _r("mode_price"))


@query("merge_heatmap")
def q_merge_heatmap(spark, sf):
    m = merge_heatmap(region_items(spark, sf, stored(perf(spark, sf), "performance")), "region")
    return m.select("region", "year_bought", "year_sold", "sale_count", *[_r(c) for c in MERGED_HEAT])


def _uneven(items: DataFrame) -> DataFrame:
    """Items whose counts are zero for even years sold, and whose percent
    metrics are null in every third cell by its count."""
    def cell(c):
        n = F.when(c["year_sold"].cast("int") % 2 == 0, F.lit(0).cast("bigint")).otherwise(c["sale_count"])
        gone = c["sale_count"] % 3 == 0
        return c.withField("sale_count", n).withField(
            "avg_appreciation_pct", F.when(gone, None).otherwise(c["avg_appreciation_pct"])).withField(
            "median_appreciation_pct", F.when(gone, None).otherwise(c["median_appreciation_pct"]))

    def point(p):
        n = F.when(p["year_sold"].cast("int") % 2 == 0, F.lit(0).cast("bigint")).otherwise(p["sale_count"])
        return p.withField("sale_count", n)

    return items.withColumn("heatmap_graph", F.transform("heatmap_graph", cell)).withColumn(
        "line_graph", F.transform("line_graph", point))


@query("merge_line_uneven")
def q_merge_line_uneven(spark, sf):
    m = merge_line(_uneven(region_items(spark, sf, stored(perf(spark, sf), "performance"))), "region")
    return m.select("region", "year_sold", "sale_count", _r("avg_price"), _r("median_price"), _r("mode_price"))


@query("merge_heatmap_uneven")
def q_merge_heatmap_uneven(spark, sf):
    m = merge_heatmap(_uneven(region_items(spark, sf, stored(perf(spark, sf), "performance"))), "region")
    return m.select("region", "year_bought", "year_sold", "sale_count", *[_r(c) for c in MERGED_HEAT])


# --- views --------------------------------------------------------------------

def served(spark, sf) -> DataFrame:
    return served_shape(perf(spark, sf))


@query("metric_long")
def q_metric_long(spark, sf):
    return metric_long(served(spark, sf)).select(
        *KEY_COLUMNS, "year_bought", "year_sold", "metric", _r("value")
    )


@query("metric_range")
def q_metric_range(spark, sf):
    return metric_range(served(spark, sf)).select(
        *KEY_COLUMNS, "metric", _r("min_value"), _r("max_value")
    )


@query("metric_scaled")
def q_metric_scaled(spark, sf):
    return metric_scaled(served(spark, sf)).select(
        *KEY_COLUMNS, "year_bought", "year_sold", "metric", _r("scaled")
    )


@query("heatmap_grid")
def q_heatmap_grid(spark, sf):
    return heatmap_grid(served(spark, sf), "median_appreciation_pounds", DATA_YEARS)


# --- declared extras ----------------------------------------------------------

@query("line_mode")
def q_line_mode(spark, sf):
    mode = extras.line_mode(extras.finest_price_counts(sales(spark, sf).select(*LINE_INPUT)))
    return mode.select(*extras.SEGMENT_YEAR, "mode_price", "sale_count")


@query("line_true_stats")
def q_line_true_stats(spark, sf):
    """Exact mode and median of the prices."""
    counts = extras.finest_price_counts(sales(spark, sf).select(*LINE_INPUT))
    return extras.line_true_stats(counts).select(*extras.SEGMENT_YEAR, "median_price", "mode_price", "sale_count")


@query("heatmap_price_stats")
def q_heatmap_price_stats(spark, sf):
    return extras.price_stats_cube(repeats(spark, sf))


def _extended_sales(spark, sf, **extra) -> DataFrame:
    parsed = parse_price_date(resolve_roles(raw(spark, sf)))
    return kept_rows(segment_columns(parsed, extra=extra), ~reserved())


@query("street_agg")
def q_street_agg(spark, sf):
    return extras.street_line(_extended_sales(spark, sf, street=normalise_of_spaced("_street")))


@query("street_heatmap")
def q_street_heatmap(spark, sf):
    s = stored(_extended_sales(spark, sf, street=normalise_of_spaced("_street")), "street-sales")
    h = extras.street_heatmap(repeat_sales(s))
    return h.select("street", "year_bought", "year_sold", *HEAT_OUT, _r("avg_appreciation_pct"))


@query("adhoc_agg")
def q_adhoc_agg(spark, sf):
    """Answered from the smallest stored aggregate with the two columns."""
    s = sales(spark, sf)
    stored_by = store_aggregates(s, scratch_path(spark, "aggregates"), [
        ["county", "outcode", "district", "house_type", "tenure"], ["district", "house_type"], ["county", "tenure"]])
    predicate = (F.col("district") == "nation_3") & (F.col("house_type") == "flat")
    return adhoc_line(spark, predicate, ["district", "house_type"], stored_by, s)


# sales that a street must have for the cube
STREET_SALES = 600


@query("street_cube")
def q_street_cube(spark, sf):
    return extras.street_cube(_extended_sales(spark, sf, street=normalise_of_spaced("_street")), STREET_SALES)


@query("bought_band_cube")
def q_bought_band_cube(spark, sf):
    """Appreciation by the band of the year bought."""
    c = extras.bought_band_cube(repeats(spark, sf))
    return c.select(*KEY_COLUMNS, "year_bought_band", "year_sold", "avg_appreciation_pounds", "sale_count",
                    _r("avg_appreciation_pct"), "pct_sales_appreciated", "biggest_loser_pounds", "biggest_loser_pct",
                    "biggest_winner_pounds", "biggest_winner_pct")


BANDED = ["house_type", "tenure", "size_band"]


def banded_sales(spark, sf) -> DataFrame:
    """Clean sales with the size band of the part that was sold."""
    s = _extended_sales(spark, sf, part=F.col("paon").cast("long"))
    p = read_table(spark, sf, "part").select("p_partkey", extras.size_band(F.col("p_size")).alias("size_band"))
    return join_dimension(s, p, F.col("part") == F.col("p_partkey"), "left").drop("part", "p_partkey")


@query("banded_cube")
def q_banded_cube(spark, sf):
    """The performance table with the size band as a third dimension."""
    return _payload(performance_from_sales(banded_sales(spark, sf), BANDED))


@query("built_band_cube")
def q_built_band_cube(spark, sf):
    """The performance table with the band of the year built as a third
    dimension; the test tables hold no such year, the house number stands
    in for it."""
    built = extras.year_band(F.lit(1950) + F.col("paon").cast("int") % 60, 20)
    s = _extended_sales(spark, sf, year_built_band=built)
    return _payload(performance_from_sales(s, ["house_type", "tenure", "year_built_band"]))
