"""Independent SQL (DuckDB dialect) for the registered queries.

Written from the semantics, not from the Spark code: the cube is a union
fan-out + CUBE, repeat sales use a plain per-property ``lag``, medians use
``quantile_disc``. Tables are the driver's pre-registered views.
"""
from __future__ import annotations

KEYS = ["location_type", "location_value", "house_type", "tenure", "size_band", "year_built_band"]
K = ", ".join(KEYS)
YEARS = [str(y) for y in range(1995, 2002)]
SNAPSHOT_YEAR = 2000
D = 6  # report digits of order-dependent means


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {strip(x)} = '')"


def norm(x: str) -> str:
    return (f"CASE WHEN {blank(x)} THEN 'unknown' ELSE "
            f"regexp_replace(replace(lower({strip(x)}), '#', ''), '\\s+', ' ', 'g') END")


def nz(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN '' ELSE {norm(x)} END"


def code_map(x: str, pairs: dict[str, str], default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items())
    return (f"CASE WHEN {blank(x)} THEN '{default}' ELSE "
            f"coalesce(CASE substr(lower({strip(x)}), 1, 1) {whens} END, '{default}') END")


def house(x: str) -> str:
    return code_map(x, {"d": "detached", "s": "semi_detached", "t": "terraced", "f": "flat", "o": "other"}, "other")


def tenure(x: str) -> str:
    return code_map(x, {"f": "freehold", "l": "leasehold"}, "unknown")


def outcode(x: str) -> str:
    return (f"CASE WHEN {blank(x)} THEN 'unknown' ELSE "
            f"replace(lower(regexp_extract({strip(x)}, '^(\\S+)', 1)), '#', '') END")


def initcap(x: str) -> str:
    return (f"array_to_string(list_transform(string_split({x}, ' '), "
            f"lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')")


def lookup_part(x: str) -> str:
    return f"lower({strip(f'coalesce(nullif({x}, {chr(39)}{chr(39)}), {chr(39)}all{chr(39)})')})"


RAW = """raw AS (
  SELECT
    CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS transaction_id,
    CAST(CAST(floor(l_extendedprice) AS BIGINT) AS VARCHAR) AS price,
    strftime(l_shipdate, '%Y-%m-%d %H:%M') AS date_of_transfer,
    CASE WHEN l_linenumber % 4 = 3 THEN lower(pc) || ' ' ELSE pc END AS postcode,
    CASE WHEN l_linenumber % 2 = 0 THEN lower(code) ELSE code END AS property_type,
    'N' AS old_new,
    translate(l_returnflag, 'ANR', 'FLU') AS duration,
    CAST(l_partkey AS VARCHAR) AS paon,
    CASE WHEN l_partkey % 6 = 3 THEN 'Flat ' || CAST(l_suppkey % 4 AS VARCHAR) ELSE '' END AS saon,
    s_name AS street,
    '' AS locality,
    n_name AS town,
    CASE WHEN l_linenumber % 2 = 0 THEN n_name ELSE lower(n_name) END AS district,
    CASE WHEN l_linenumber % 3 = 0 THEN r_name
         WHEN l_linenumber % 3 = 1 THEN '  ' || lower(r_name) || ' '
         ELSE replace(r_name, ' ', '  ') END AS county,
    'A' AS ppd_category_type,
    'A' AS record_status
  FROM (SELECT *,
          'E' || CAST(l_partkey % 50 AS VARCHAR) || ' ' || CAST(l_suppkey % 9 AS VARCHAR) || 'AB' AS pc,
          ['D', 'S', 'T', 'F', 'O', 'X'][CAST(l_partkey % 6 AS INTEGER) + 1] AS code
        FROM lineitem) li
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

PARSED = """parsed AS (
  SELECT *, TRY_CAST(price AS DOUBLE) AS price_d,
    TRY_CAST(try_strptime(substr(trim(date_of_transfer), 1, 10), '%Y-%m-%d') AS DATE) AS sale_date
  FROM raw
)"""


NOT_RESERVED = "NOT ('all' IN (county, outcode, district, house_type, tenure))"


def sales_cte(where: str = "TRUE", name: str = "sales", extra: str = "", keep: str = NOT_RESERVED) -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT transaction_id,
    {nz('postcode')} || '|' || {nz('paon')} || '|' || {nz('saon')} || '|' || {nz('street')} AS property_id,
    price_d AS price, sale_date, CAST(year(sale_date) AS INTEGER) AS year_sold,
    {norm('county')} AS county, {outcode('postcode')} AS outcode, {norm('district')} AS district,
    {house('property_type')} AS house_type, {tenure('duration')} AS tenure{extra}
  FROM parsed WHERE price_d IS NOT NULL AND sale_date IS NOT NULL AND {where}
) s WHERE {keep})"""


def repeats_cte(src: str = "sales", name: str = "repeats") -> str:
    return f"""{name}_lagged AS (
  SELECT *, lag(sale_date) OVER w AS bought_date, lag(price) OVER w AS bought_price
  FROM {src}
  WINDOW w AS (PARTITION BY property_id ORDER BY sale_date, price, transaction_id NULLS FIRST)
),
{name} AS (
  SELECT *, CAST(year(bought_date) AS INTEGER) AS year_bought,
    price - bought_price AS appreciation_pounds,
    CASE WHEN bought_price > 0 THEN (price - bought_price) / bought_price * 100 END AS appreciation_pct
  FROM {name}_lagged WHERE bought_date IS NOT NULL
)"""


def fan_cte(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, 'county' AS location_type, county AS location_value FROM {src}
  UNION ALL SELECT *, 'postcode' AS location_type, outcode AS location_value FROM {src}
  UNION ALL SELECT *, 'borough' AS location_type, district AS location_value FROM {src}
)"""


def cube_cte(src: str, name: str, by: list[str], metrics: str) -> str:
    b = ", ".join(by)
    return f"""{fan_cte(src, name + '_fan')},
{name} AS (
  SELECT location_type,
    CASE WHEN grouping(location_value) = 1 THEN 'all' ELSE location_value END AS location_value,
    CASE WHEN grouping(house_type) = 1 THEN 'all' ELSE house_type END AS house_type,
    CASE WHEN grouping(tenure) = 1 THEN 'all' ELSE tenure END AS tenure,
    'all' AS size_band, 'all' AS year_built_band, {b},
    {metrics}
  FROM {name}_fan
  GROUP BY location_type, {b}, CUBE(location_value, house_type, tenure)
)"""


LINE_METRICS = """sum(price) / count(*) AS avg_price,
    sum(price) / count(*) AS median_price,
    sum(price) / count(*) AS mode_price,
    count(*) AS sale_count"""

HEAT_METRICS = f"""sum(appreciation_pounds) / count(appreciation_pounds) AS avg_appreciation_pounds,
    quantile_disc(appreciation_pounds, 0.5) AS median_appreciation_pounds,
    count(*) AS sale_count,
    avg(appreciation_pct) AS avg_appreciation_pct,
    quantile_disc(appreciation_pct, 0.5) AS median_appreciation_pct,
    CAST(100 * count_if(appreciation_pounds > 0) AS DOUBLE) / count(*) AS pct_sales_appreciated,
    min(appreciation_pounds) AS biggest_loser_pounds,
    min(appreciation_pct) AS biggest_loser_pct,
    max(appreciation_pounds) AS biggest_winner_pounds,
    max(appreciation_pct) AS biggest_winner_pct"""

HEAT_OUT = ("avg_appreciation_pounds, median_appreciation_pounds, sale_count, median_appreciation_pct, "
            "pct_sales_appreciated, biggest_loser_pounds, biggest_loser_pct, biggest_winner_pounds, "
            f"biggest_winner_pct, round(avg_appreciation_pct, {D}) AS avg_appreciation_pct")


def base(*ctes: str) -> str:
    return "WITH " + ",\n".join([RAW, PARSED, *ctes]) + "\n"


O = "CAST(split_part(transaction_id, '-', 1) AS BIGINT)"
N = "CAST(split_part(transaction_id, '-', 2) AS BIGINT)"
DIRTY = f"""raw AS (SELECT * REPLACE (
    CASE WHEN {O} % 17 = 0 THEN 'n/a' WHEN {O} % 19 = 0 THEN '12,500' WHEN {O} % 13 = 0 THEN ' 0 '
      WHEN {O} % 59 = 0 THEN 'Infinity' WHEN {O} % 61 = 0 THEN '1e999' ELSE price END AS price,
    CASE WHEN {O} % 23 = 0 THEN '1996-02-31 00:00' WHEN {O} % 29 = 0 THEN '' ELSE date_of_transfer END AS date_of_transfer,
    CASE WHEN {O} % 31 = 0 THEN ' All ' WHEN {O} % 37 = 0 THEN '  ' ELSE county END AS county,
    CASE WHEN {O} % 41 = 0 AND {N} % 2 = 0 THEN 'ALL' ELSE district END AS district,
    CASE WHEN {O} % 43 = 0 THEN '' ELSE postcode END AS postcode,
    CASE WHEN {O} % 47 = 0 THEN '' ELSE property_type END AS property_type,
    CASE WHEN {O} % 53 = 0 THEN NULL ELSE duration END AS duration) FROM raw0
)"""


def dirty(*ctes: str) -> str:
    return "WITH " + ",\n".join([RAW.replace("raw AS (", "raw0 AS (", 1), DIRTY, PARSED, *ctes]) + "\n"


LINE = cube_cte("sales", "line", ["year_sold"], LINE_METRICS)
HEAT = cube_cte("repeats", "heat", ["year_bought", "year_sold"], HEAT_METRICS)
PERF = f"""perf AS (
  SELECT l.*, coalesce(h.heatmap_cells, 0) AS heatmap_cells, coalesce(h.repeat_sale_count, 0) AS repeat_sale_count
  FROM (SELECT {K}, CAST(sum(sale_count) AS BIGINT) AS sale_count, CAST(count(*) AS INTEGER) AS line_points
        FROM line GROUP BY {K}) l
  LEFT JOIN (SELECT {K}, CAST(count(*) AS INTEGER) AS heatmap_cells, CAST(sum(sale_count) AS BIGINT) AS repeat_sale_count
             FROM heat GROUP BY {K}) h USING ({K})
)"""
FULL = [sales_cte(), repeats_cte(), LINE, HEAT, PERF]
# the same of the sales before the cut-over year, and what the second load leaves alone
BEFORE = [f"sales_b AS (SELECT * FROM sales WHERE year_sold < {SNAPSHOT_YEAR})", repeats_cte("sales_b", "repeats_b"),
          cube_cte("sales_b", "line_b", ["year_sold"], LINE_METRICS),
          cube_cte("repeats_b", "heat_b", ["year_bought", "year_sold"], HEAT_METRICS),
          PERF.replace("perf AS", "perf_b AS").replace("FROM line ", "FROM line_b ").replace("FROM heat ", "FROM heat_b ")]
LEFT_ALONE = 4

# served heatmap cells (one row per cell, years as text)
CELLS = f"""cells AS (
  SELECT {K}, CAST(year_bought AS VARCHAR) AS year_bought, CAST(year_sold AS VARCHAR) AS year_sold,
    coalesce(avg_appreciation_pounds, 0.0) AS avg_appreciation_pounds,
    coalesce(median_appreciation_pounds, 0.0) AS median_appreciation_pounds,
    sale_count, avg_appreciation_pct, median_appreciation_pct,
    coalesce(pct_sales_appreciated, 0.0) AS pct_sales_appreciated
  FROM heat
)"""

DIM_PAIRS = [
    ("county", "CASE WHEN location_type = 'county' THEN location_value END", "location_value"),
    ("postcode", "CASE WHEN location_type = 'postcode' THEN location_value END", "location_value"),
    ("borough", "CASE WHEN location_type = 'borough' THEN location_value END", "location_value"),
    ("house_type", "house_type", "house_type"),
    ("tenure", "tenure", "tenure"),
    ("size_band", "size_band", "size_band"),
    ("year_built_band", "year_built_band", "year_built_band"),
]
PARTS = ["location_value", "house_type", "tenure", "size_band", "year_built_band"]


def dims_cte(src: str = "perf", name: str = "dims") -> str:
    selects = []
    for dim, expr, own in DIM_PAIRS:
        others = " AND ".join(f"{p} = 'all'" for p in PARTS if p != own)
        selects.append(f"SELECT '{dim}' AS dimension_name, {expr} AS value, "
                       f"CASE WHEN {others} THEN sale_count END AS own_count FROM {src}")
    union = "\n    UNION ALL ".join(selects)
    label = (f"CASE WHEN dimension_name IN ('county', 'borough', 'tenure') THEN {initcap('value')} "
             f"WHEN dimension_name = 'postcode' THEN upper(value) "
             f"WHEN dimension_name = 'house_type' THEN {initcap(chr(114) + 'eplace(value, ' + chr(39) + '_' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ')')} "
             f"ELSE value END")
    return f"""{name}_stacked AS (
    {union}
),
{name} AS (
  SELECT dimension_name, value, {label} AS label, CAST(max(own_count) AS BIGINT) AS sale_count
  FROM {name}_stacked WHERE value IS NOT NULL GROUP BY dimension_name, value
)"""


REQUESTS = """requests AS (
  SELECT c_custkey AS request_id,
    CASE WHEN c_custkey % 11 = 0 THEN 'city' WHEN c_custkey % 3 = 0 THEN 'county'
         WHEN c_custkey % 3 = 1 THEN 'borough' ELSE 'postcode' END AS location_type,
    CASE WHEN c_custkey % 13 = 0 THEN '' WHEN c_custkey % 3 = 0 THEN r_name
         WHEN c_custkey % 3 = 1 THEN ' ' || n_name || ' '
         ELSE 'E' || CAST(c_custkey % 50 AS VARCHAR) END AS location_value,
    CASE c_custkey % 5 WHEN 0 THEN 'Detached' WHEN 1 THEN '' WHEN 2 THEN ' FLAT' WHEN 3 THEN NULL
         ELSE 'semi_detached' END AS house_type,
    CASE c_custkey % 4 WHEN 0 THEN 'Freehold' WHEN 1 THEN 'all' WHEN 2 THEN NULL ELSE 'LEASEHOLD ' END AS tenure,
    CAST(NULL AS VARCHAR) AS size_band, 'ALL' AS year_built_band
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""

VALID = ("location_type IN ('county', 'postcode', 'borough', 'street') "
         "AND location_value IS NOT NULL AND length(location_value) >= 1")

NREQ = f"""nreq AS (
  SELECT request_id, location_type,
    CASE WHEN location_type = 'street' THEN {strip('location_value')} ELSE lower({strip('location_value')}) END AS location_value,
    {lookup_part('house_type')} AS house_type, {lookup_part('tenure')} AS tenure,
    {lookup_part('size_band')} AS size_band, {lookup_part('year_built_band')} AS year_built_band
  FROM requests WHERE {VALID}
)"""

LINE_FLAT = f"""SELECT {K},
    CAST(row_number() OVER (PARTITION BY {K} ORDER BY CAST(year_sold AS VARCHAR)) - 1 AS INTEGER) AS pos,
    CAST(year_sold AS VARCHAR) AS year_sold, avg_price, median_price, mode_price, sale_count,
    CAST(sum(sale_count) OVER (PARTITION BY {K}) AS BIGINT) AS total_sale_count
  FROM line"""

REGION_ITEMS = """region_map AS (
  SELECT lower(n_name) AS location_value, lower(r_name) AS region
  FROM nation JOIN region ON n_regionkey = r_regionkey
),
items AS (
  SELECT DISTINCT m.region, p.location_value FROM perf p JOIN region_map m USING (location_value)
  WHERE p.location_type = 'borough' AND p.house_type = 'all' AND p.tenure = 'all'
),
n_items AS (SELECT region, count(*) AS n_items FROM items GROUP BY region)"""


def weighted(v: str) -> str:
    return (f"round(CASE WHEN max(n_items) = 1 THEN max({v}) WHEN sum(sale_count) = 0 THEN avg({v}) "
            f"ELSE sum({v} * sale_count) / sum(sale_count) END, {D}) AS {v}")


def weighted_pct(v: str) -> str:
    return (f"round(CASE WHEN max(n_items) = 1 THEN max({v}) "
            f"WHEN sum(sale_count) = 0 THEN avg(coalesce({v}, 0.0)) "
            f"ELSE sum(CASE WHEN {v} IS NOT NULL THEN {v} * sale_count END) "
            f"/ nullif(sum(CASE WHEN {v} IS NOT NULL THEN sale_count END), 0) END, {D}) AS {v}")


def metric_long_cte() -> str:
    metrics = ["avg_appreciation_pounds", "median_appreciation_pounds", "sale_count",
               "avg_appreciation_pct", "median_appreciation_pct", "pct_sales_appreciated"]
    parts = [f"SELECT {K}, year_bought, year_sold, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM cells"
             for m in metrics]
    return "long AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


LINE_VALUES = ["avg_price", "median_price", "mode_price"]
CELL_VALUES = ["avg_appreciation_pounds", "median_appreciation_pounds", "avg_appreciation_pct", "median_appreciation_pct",
               "pct_sales_appreciated", "biggest_loser_pounds", "biggest_loser_pct", "biggest_winner_pounds",
               "biggest_winner_pct"]
NULLABLE = [v for v in CELL_VALUES if v.endswith("_pct")]


def exported_value(v: str) -> str:
    """A number as the JSON export rounds it, missing pounds as 0."""
    x = v if v in NULLABLE or v.startswith("biggest") else f"coalesce({v}, 0.0)"
    digits = 1 if v == "pct_sales_appreciated" else 2
    return f"CAST(format('{{:.{digits}f}}', {x}) AS DOUBLE) + 0.0"  # no negative zero


def number_text(v: str) -> str:
    """An exported number as text: 12.5, from ten million on 1.25E7."""
    x = exported_value(v)
    digits = f"replace(CAST(abs({x}) AS VARCHAR), '.', '')"
    large = (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END) || left({digits}, 1) || '.' || coalesce(nullif(rtrim(substr({digits}, 2), '0'), ''), '0') "
             f"|| 'E' || (length(split_part(CAST(abs({x}) AS VARCHAR), '.', 1)) - 1)")
    return f"(CASE WHEN {v} IS NULL AND {x} IS NULL THEN 'null' WHEN abs({x}) < 1e7 THEN CAST({x} AS VARCHAR) ELSE {large} END)"


def quoted(v: str) -> str:
    return f"""'"' || {v} || '"'"""


def item_text(fields: list[tuple[str, str]]) -> str:
    return "'{' || " + " || ',' || ".join(f"""'"{name}":' || {text}""" for name, text in fields) + " || '}'"


def payload(keys: list[str] = KEYS, where: str = "TRUE", exported: bool = False, suffix: str = "") -> str:
    """Every line point and heatmap cell of the table; ``exported``: rounded
    as the JSON export rounds, missing pounds as 0."""
    def val(v: str) -> str:
        return f"{exported_value(v)} AS {v}" if exported else f"round({v}, {D}) AS {v}"

    none = lambda vs: ", ".join(f"CAST(NULL AS DOUBLE) AS {v}" for v in vs)
    k = ", ".join(keys)
    return f"""SELECT * FROM (
  SELECT {k}, t.sale_count AS total_sale_count, 'line' AS kind, CAST(NULL AS VARCHAR) AS year_bought,
    CAST(l.year_sold AS VARCHAR) AS year_sold, l.sale_count, {', '.join(map(val, LINE_VALUES))}, {none(CELL_VALUES)}
  FROM line{suffix} l JOIN (SELECT {k}, sale_count FROM perf{suffix}) t USING ({k})
  UNION ALL
  SELECT {k}, t.sale_count, 'cell', CAST(h.year_bought AS VARCHAR), CAST(h.year_sold AS VARCHAR), h.sale_count,
    {none(LINE_VALUES)}, {', '.join(map(val, CELL_VALUES))}
  FROM heat{suffix} h JOIN (SELECT {k}, sale_count FROM perf{suffix}) t USING ({k})) p WHERE {where}"""


METRICS = ["avg_appreciation_pounds", "median_appreciation_pounds", "sale_count",
           "avg_appreciation_pct", "median_appreciation_pct", "pct_sales_appreciated"]


def _sql() -> dict[str, str]:
    q: dict[str, str] = {}
    sale_out = ("transaction_id, property_id, price, year_sold, county, outcode, district, house_type, tenure, "
                "strftime(sale_date, '%Y-%m-%d') AS sale_date")

    # sources / sinks
    q["scan_csv"] = base() + "SELECT " + ", ".join(
        f"nullif({c}, '') AS {c}" for c in [
            "transaction_id", "price", "date_of_transfer", "postcode", "property_type", "old_new",
            "duration", "paon", "saon", "street", "locality", "town", "district", "county",
            "ppd_category_type", "record_status"]) + " FROM raw"
    q["resolve_roles"] = base() + ("SELECT transaction_id, price, date_of_transfer AS date, postcode, property_type, "
                                   "duration, county, district, paon, saon, street FROM raw")
    q["csv_rejects"] = base() + f"""SELECT transaction_id,
    CASE WHEN {O} % 17 = 0 THEN 'fields' WHEN {O} % 19 = 0 THEN 'quotes' END AS reject,
    CASE WHEN {O} % 17 <> 0 AND {O} % 19 <> 0 THEN CASE WHEN {O} % 23 <> 0 AND {O} % 29 = 0 THEN street || ', x' ELSE street END END AS street,
    CASE WHEN {O} % 17 <> 0 AND {O} % 19 <> 0 AND {O} % 23 <> 0 THEN record_status END AS record_status
  FROM raw"""
    summary = payload()
    exported = payload(exported=True)
    q["write_read_parquet"] = base(*FULL) + summary
    for name in ("import_json", "roundtrip_csv"):
        q[name] = base(*FULL) + exported
    # the whole text of an item, its numbers as the export writes them
    point = item_text([("year_sold", quoted("year_sold")), *[(v, number_text(v)) for v in LINE_VALUES], ("sale_count", "sale_count")])
    cell = item_text([("year_bought", quoted("year_bought")), ("year_sold", quoted("year_sold")),
                      *[(v, "sale_count" if v == "sale_count" else number_text(v)) for v in [*CELL_VALUES[:2], "sale_count", *CELL_VALUES[2:]]]])
    q["export_json"] = base(*FULL) + f"""SELECT concat_ws('#', {K}) AS key,
    '{{"line_graph":[' || l.t || '],"heatmap_graph":[' || coalesce(h.t, '') || '],"sale_count":' || l.n || '}}' AS text
  FROM (SELECT {K}, sum(sale_count) AS n, string_agg({point}, ',' ORDER BY year_sold) AS t FROM line GROUP BY {K}) l
  LEFT JOIN (SELECT {K}, string_agg({cell}, ',' ORDER BY year_bought, year_sold) AS t
             FROM heat GROUP BY {K}) h USING ({K})"""
    # a second load over a table of the sales before the cut-over year
    q["upsert_performance"] = base(*FULL, *BEFORE) + f"""SELECT * FROM (
  {payload(where=f"total_sale_count % {LEFT_ALONE} <> 0", exported=True)}
  UNION ALL SELECT b.* FROM ({payload(exported=True, suffix="_b")}) b ANTI JOIN
    (SELECT * FROM perf WHERE sale_count % {LEFT_ALONE} <> 0) f USING ({K})) p"""
    q["upsert_sequence"] = base(*FULL) + (
        f"SELECT {K}, CASE WHEN sale_count % 5 = 0 OR (sale_count % 3 <> 0 AND sale_count % 2 = 1) THEN sale_count ELSE -sale_count END AS sale_count, "
        "CAST(CASE WHEN sale_count % 5 = 0 OR (sale_count % 3 <> 0 AND sale_count % 2 = 1) THEN 5 WHEN sale_count % 2 = 1 THEN 4 ELSE 6 END AS BIGINT) "
        "AS load_seq FROM perf WHERE sale_count % 3 <> 0 OR sale_count % 5 <> 0")
    q["upsert_dimension"] = base(*FULL, dims_cte(), *BEFORE, dims_cte("perf_b", "dims_b")) + f"""SELECT dimension_name, value, label, sale_count
  FROM dims WHERE coalesce(sale_count, 1) % {LEFT_ALONE} <> 0
  UNION ALL SELECT b.dimension_name, b.value, b.label, b.sale_count FROM dims_b b ANTI JOIN
    (SELECT * FROM dims WHERE coalesce(sale_count, 1) % {LEFT_ALONE} <> 0) d USING (dimension_name, value)"""
    q["upsert_touched"] = base(*FULL) + f"""SELECT {K}, CASE WHEN location_type = 'borough' AND location_value = 'nation_3'
    AND house_type = 'flat' THEN -sale_count ELSE sale_count END AS sale_count, 1 AS file_ok FROM perf"""
    n = "coalesce(sale_count, 1)"
    ok = f"{n} % 7 <> 0 AND {n} % 5 <> 0"
    q["load_report"] = base(*FULL, dims_cte()) + f"""SELECT count(*) AS rows_read, count_if({n} % 7 = 0)::BIGINT AS blank_key,
    count_if({n} % 7 <> 0 AND {n} % 5 = 0)::BIGINT AS malformed,
    count_if({ok} AND ({n} % 3 = 0 OR value = ''))::BIGINT AS missing_sk,
    count_if({ok} AND {n} % 3 <> 0 AND value <> '')::BIGINT AS loaded FROM dims"""
    q["load_dirty"] = base(*FULL, dims_cte()) + (
        f"SELECT dimension_name, value, label, sale_count FROM dims WHERE {ok} AND {n} % 3 <> 0 AND value <> ''")

    # dirty sales
    q["dirty_sales"] = dirty(sales_cte()) + f"SELECT {sale_out} FROM sales"
    q["dirty_rejects"] = dirty() + f"""SELECT reason, count(*) AS "rows" FROM (
    SELECT CASE WHEN price_d IS NULL THEN 'price' WHEN sale_date IS NULL THEN 'date'
      WHEN 'all' IN ({norm('county')}, {outcode('postcode')}, {norm('district')}) THEN 'reserved' END AS reason FROM parsed) r
  WHERE reason IS NOT NULL GROUP BY reason"""
    q["dirty_performance"] = dirty(*FULL) + summary

    # projections / scalar functions
    q["clean_sales"] = base(sales_cte()) + f"SELECT {sale_out} FROM sales"
    q["reserved_values"] = dirty(sales_cte(keep="TRUE")) + """SELECT count(*) AS sales,
    CAST(count_if(county = 'all') AS BIGINT) AS county_all,
    CAST(count_if(outcode = 'all') AS BIGINT) AS outcode_all,
    CAST(count_if(district = 'all') AS BIGINT) AS district_all,
    CAST(count_if(house_type = 'all') AS BIGINT) AS house_type_all,
    CAST(count_if(tenure = 'all') AS BIGINT) AS tenure_all,
    CAST(count_if(regexp_matches(property_id, '^[^|]*\\|\\|\\|$')) AS BIGINT) AS no_address
  FROM sales"""
    q["prefilter_borough"] = base(sales_cte("lower(trim(district)) = 'nation_7'")) + f"SELECT {sale_out} FROM sales"
    q["segment_columns"] = base(sales_cte()) + ("SELECT transaction_id, county, outcode, district, house_type, tenure, "
                                                "'all' AS size_band, 'all' AS year_built_band FROM sales")
    q["f_normalise"] = base() + (f"SELECT transaction_id, {norm('county')} AS county, {norm('district')} AS district, "
                                 f"{norm('street')} AS street, {norm('saon')} AS saon, {nz('saon')} AS saon_or_empty FROM raw")
    q["property_id"] = base() + (f"SELECT transaction_id, {nz('postcode')} || '|' || {nz('paon')} || '|' || "
                                 f"{nz('saon')} || '|' || {nz('street')} AS property_id FROM raw")
    q["f_house_type"] = base() + f"SELECT transaction_id, property_type, {house('property_type')} AS house_type FROM raw"
    q["f_tenure"] = base() + f"SELECT transaction_id, duration, {tenure('duration')} AS tenure FROM raw"
    q["f_outcode"] = base() + f"SELECT transaction_id, postcode, {outcode('postcode')} AS outcode FROM raw"
    q["segment_key"] = base(*FULL) + f"SELECT concat_ws('#', {K}) AS key, sale_count FROM perf"
    q["split_key"] = base(*FULL) + f"SELECT {K}, sale_count FROM perf"

    # repeat sales
    q["repeat_sales"] = base(sales_cte(), repeats_cte()) + (
        "SELECT transaction_id, property_id, price, bought_price, year_bought, year_sold, "
        "strftime(sale_date, '%Y-%m-%d') AS sale_date, strftime(bought_date, '%Y-%m-%d') AS bought_date FROM repeats")
    q["appreciation"] = base(sales_cte(), repeats_cte()) + (
        "SELECT transaction_id, appreciation_pounds, appreciation_pct FROM repeats")

    q["pairs_in_loads"] = q["repeat_sales"]

    # cube
    q["location_fanout"] = base(sales_cte(), fan_cte("sales", "fan")) + (
        "SELECT transaction_id, location_type, location_value FROM fan")
    cube_sql = base(sales_cte(), LINE) + f"SELECT {K}, year_sold, avg_price, median_price, mode_price, sale_count FROM line"
    q["segment_cube"] = cube_sql
    q["segment_cube_gs"] = cube_sql
    q["line_agg"] = cube_sql
    q["incremental_line"] = cube_sql
    q["affected_keys"] = base(sales_cte(), fan_cte("sales", "fan")) + """, segs AS (
  SELECT DISTINCT location_type, location_value, house_type, tenure, 'all' AS size_band, 'all' AS year_built_band
  FROM fan
), masked AS (SELECT *, unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS mask FROM segs)
SELECT location_type, size_band, year_built_band, mask,
  CASE WHEN (mask & 4) <> 0 THEN 'all' ELSE location_value END AS affected_location_value,
  CASE WHEN (mask & 2) <> 0 THEN 'all' ELSE house_type END AS affected_house_type,
  CASE WHEN (mask & 1) <> 0 THEN 'all' ELSE tenure END AS affected_tenure,
  location_value, house_type, tenure
FROM masked""".replace("WITH", "", 0)

    # aggregates / series / tables
    q["heatmap_agg"] = base(sales_cte(), repeats_cte(), HEAT) + f"SELECT {K}, year_bought, year_sold, {HEAT_OUT} FROM heat"
    q["line_series"] = base(sales_cte(), LINE) + LINE_FLAT
    q["heatmap_series"] = base(sales_cte(), repeats_cte(), HEAT) + f"""SELECT {K},
    CAST(row_number() OVER (PARTITION BY {K} ORDER BY CAST(year_bought AS VARCHAR), CAST(year_sold AS VARCHAR)) - 1 AS INTEGER) AS pos,
    CAST(year_bought AS VARCHAR) AS year_bought, CAST(year_sold AS VARCHAR) AS year_sold, {HEAT_OUT}
  FROM heat"""
    q["performance_table"] = base(*FULL) + summary
    q["performance_join"] = base(*FULL) + summary
    q["dimension_index"] = base(*FULL, dims_cte()) + "SELECT dimension_name, value, label, sale_count FROM dims"
    q["list_dimension"] = base(*FULL, dims_cte()) + (
        "SELECT dimension_name, value, label, sale_count FROM dims WHERE dimension_name = 'borough'")

    # serving
    q["lookup_segment"] = base(sales_cte(), LINE) + f"""SELECT * FROM ({LINE_FLAT}) t
  WHERE location_type = 'county' AND location_value = 'europe' AND house_type = 'all' AND tenure = 'all'"""
    q["served_shape"] = base(*FULL, CELLS) + f"""SELECT {K}, year_bought, year_sold, avg_appreciation_pounds,
    median_appreciation_pounds, sale_count, median_appreciation_pct, pct_sales_appreciated,
    round(avg_appreciation_pct, {D}) AS avg_appreciation_pct FROM cells"""
    q["validate_requests"] = base(REQUESTS) + f"""SELECT request_id,
    CASE WHEN {VALID} THEN 1 ELSE 0 END AS valid,
    CASE WHEN location_type IS NULL OR location_type NOT IN ('county', 'postcode', 'borough', 'street') THEN 'location_type'
         WHEN location_value IS NULL OR length(location_value) < 1 THEN 'location_value' END AS reason
  FROM requests"""
    served = [v for v in CELL_VALUES if not v.startswith("biggest")]
    nulls = lambda vs: ", ".join(f"CAST(NULL AS DOUBLE) AS {v}" for v in vs)
    rounded = lambda vs: ", ".join(f"round({v}, {D}) AS {v}" for v in vs)
    q["lookup_batch"] = base(*FULL, CELLS, REQUESTS, NREQ) + f"""SELECT request_id,
    CAST(CASE WHEN p.sale_count IS NULL THEN 0 ELSE 1 END AS BIGINT) AS match_count, 'answer' AS kind,
    CAST(NULL AS VARCHAR) AS year_bought, CAST(NULL AS VARCHAR) AS year_sold, p.sale_count, {nulls(LINE_VALUES + served)}
  FROM nreq LEFT JOIN perf p USING ({K})
  UNION ALL SELECT request_id, 1, 'line', NULL, CAST(year_sold AS VARCHAR), sale_count, {rounded(LINE_VALUES)}, {nulls(served)}
  FROM nreq JOIN line USING ({K})
  UNION ALL SELECT request_id, 1, 'cell', year_bought, year_sold, sale_count, {nulls(LINE_VALUES)}, {rounded(served)}
  FROM nreq JOIN cells USING ({K})"""
    q["rejected_requests"] = base(REQUESTS) + f"""SELECT request_id,
    CASE WHEN location_type IS NULL OR location_type NOT IN ('county', 'postcode', 'borough', 'street') THEN 'location_type'
         ELSE 'location_value' END AS reason
  FROM requests WHERE NOT coalesce({VALID}, false)"""
    q["query_line"] = base(*FULL, REQUESTS, NREQ) + f"""SELECT request_id, CAST(year_sold AS VARCHAR) AS year_sold,
    sale_count, round(avg_price, {D}) AS avg_price, round(median_price, {D}) AS median_price,
    round(mode_price, {D}) AS mode_price
  FROM nreq LEFT JOIN line USING ({K})"""
    q["query_heatmap"] = base(*FULL, CELLS, REQUESTS, NREQ) + f"""SELECT request_id, year_bought, year_sold, sale_count,
    round(avg_appreciation_pounds, {D}) AS avg_appreciation_pounds,
    round(median_appreciation_pounds, {D}) AS median_appreciation_pounds,
    round(avg_appreciation_pct, {D}) AS avg_appreciation_pct,
    round(median_appreciation_pct, {D}) AS median_appreciation_pct,
    round(pct_sales_appreciated, {D}) AS pct_sales_appreciated
  FROM nreq LEFT JOIN cells USING ({K})"""
    uneven = """line_u AS (SELECT * REPLACE (CASE WHEN year_sold % 2 = 0 THEN 0 ELSE sale_count END AS sale_count) FROM line),
cells_u AS (SELECT * REPLACE (CASE WHEN CAST(year_sold AS INTEGER) % 2 = 0 THEN 0 ELSE sale_count END AS sale_count,
    CASE WHEN sale_count % 3 <> 0 THEN avg_appreciation_pct END AS avg_appreciation_pct,
    CASE WHEN sale_count % 3 <> 0 THEN median_appreciation_pct END AS median_appreciation_pct) FROM cells)"""
    for name, line_from, cells_from, more in (("", "line", "cells", []), ("_uneven", "line_u", "cells_u", [uneven])):
        q[f"merge_line{name}"] = base(*FULL, CELLS, *more, REGION_ITEMS) + f"""SELECT i.region, CAST(l.year_sold AS VARCHAR) AS year_sold,
    CAST(sum(l.sale_count) AS BIGINT) AS sale_count,
    {weighted('avg_price')}, {weighted('median_price')}, {weighted('mode_price')}
  FROM {line_from} l JOIN items i USING (location_value) JOIN n_items USING (region)
  WHERE l.location_type = 'borough' AND l.house_type = 'all' AND l.tenure = 'all'
  GROUP BY i.region, l.year_sold"""
        q[f"merge_heatmap{name}"] = base(*FULL, CELLS, *more, REGION_ITEMS) + f"""SELECT i.region, c.year_bought, c.year_sold,
    CAST(sum(c.sale_count) AS BIGINT) AS sale_count,
    {weighted('avg_appreciation_pounds')}, {weighted('median_appreciation_pounds')},
    {weighted('pct_sales_appreciated')},
    {weighted_pct('avg_appreciation_pct')}, {weighted_pct('median_appreciation_pct')}
  FROM {cells_from} c JOIN items i USING (location_value) JOIN n_items USING (region)
  WHERE c.location_type = 'borough' AND c.house_type = 'all' AND c.tenure = 'all'
  GROUP BY i.region, c.year_bought, c.year_sold"""

    # views
    q["metric_long"] = base(*FULL, CELLS, metric_long_cte()) + (
        f"SELECT {K}, year_bought, year_sold, metric, round(value, {D}) AS value FROM long")
    q["metric_range"] = base(*FULL, CELLS, metric_long_cte()) + f"""SELECT {K}, metric,
    round(coalesce(min(value), 0.0), {D}) AS min_value,
    round(CASE WHEN max(value) IS NULL OR max(value) <= coalesce(min(value), 0.0) THEN coalesce(min(value), 0.0) + 1
               ELSE max(value) END, {D}) AS max_value
  FROM perf CROSS JOIN (SELECT unnest({METRICS}) AS metric) m LEFT JOIN long USING ({K}, metric) GROUP BY {K}, metric"""
    q["metric_scaled"] = base(*FULL, CELLS, metric_long_cte()) + f""", ranged AS (
  SELECT *, coalesce(min(value) OVER w, 0.0) AS lo, max(value) OVER w AS hi_raw
  FROM long WINDOW w AS (PARTITION BY {K}, metric)
)
SELECT {K}, year_bought, year_sold, metric,
  round((value - lo) / (CASE WHEN hi_raw IS NULL OR hi_raw <= lo THEN lo + 1 ELSE hi_raw END - lo), {D}) AS scaled
FROM ranged"""
    years = ", ".join(f"'{y}'" for y in YEARS)
    ycols = ", ".join(f"y{y}" for y in YEARS)

    def grid(start, metric: str) -> str:
        pivots = ", ".join(f"max(CASE WHEN year_sold = '{y}' THEN {metric} END) AS y{y}" for y in YEARS)
        return start(*FULL, CELLS) + f""", frame AS (
  SELECT {K}, unnest([{years}]) AS year_bought FROM perf
), piv AS (
  SELECT {K}, year_bought, {pivots}
  FROM cells WHERE year_bought IN ({years}) AND year_sold IN ({years})
  GROUP BY {K}, year_bought
)
SELECT {K}, year_bought, {ycols} FROM frame LEFT JOIN piv USING ({K}, year_bought)"""

    q["heatmap_grid"] = grid(base, "median_appreciation_pounds")
    q["dirty_grid"] = grid(dirty, "median_appreciation_pct")

    # declared extras
    q["line_mode"] = base(
        sales_cte(),
        cube_cte("sales", "pp", ["year_sold", "price"], "count(*) AS n"),
    ) + f"""SELECT {K}, year_sold, mode_price, CAST(sale_count AS BIGINT) AS sale_count FROM (
    SELECT *, price AS mode_price, sum(n) OVER (PARTITION BY {K}, year_sold) AS sale_count,
      row_number() OVER (PARTITION BY {K}, year_sold ORDER BY n DESC, price ASC) AS rk FROM pp) t
  WHERE rk = 1"""
    q["heatmap_price_stats"] = base(sales_cte(), repeats_cte(), cube_cte(
        "repeats", "hp", ["year_bought", "year_sold"],
        """sum(price) / count(*) AS avg_price, quantile_disc(price, 0.5) AS median_price,
    min(price) AS min_price, max(price) AS max_price, count(*) AS sale_count,
    CAST(100 * count_if(appreciation_pounds < 0) AS DOUBLE) / count(*) AS pct_sales_at_loss""")) + (
        f"SELECT {K}, year_bought, year_sold, avg_price, median_price, min_price, max_price, sale_count, "
        "pct_sales_at_loss FROM hp")
    q["street_agg"] = base(sales_cte(extra=f", {norm('street')} AS street")) + (
        "SELECT street, year_sold, sum(price) / count(*) AS avg_price, count(*) AS sale_count "
        "FROM sales GROUP BY street, year_sold")
    q["line_true_stats"] = base(
        sales_cte(),
        cube_cte("sales", "pp", ["year_sold", "price"], "count(*) AS n"),
        cube_cte("sales", "pm", ["year_sold"], "quantile_disc(price, 0.5) AS median_price"),
    ) + f"""SELECT {K}, year_sold, median_price, mode_price, CAST(sale_count AS BIGINT) AS sale_count FROM (
    SELECT *, price AS mode_price, sum(n) OVER (PARTITION BY {K}, year_sold) AS sale_count,
      row_number() OVER (PARTITION BY {K}, year_sold ORDER BY n DESC, price ASC) AS rk FROM pp) t
  JOIN pm USING ({K}, year_sold) WHERE rk = 1"""
    q["street_heatmap"] = base(sales_cte(extra=f", {norm('street')} AS street"), repeats_cte()) + (
        f"SELECT street, year_bought, year_sold, {HEAT_OUT} FROM (SELECT street, year_bought, year_sold, {HEAT_METRICS} "
        "FROM repeats GROUP BY street, year_bought, year_sold) h")
    banded = [sales_cte(name="sales0", extra=", CAST(paon AS BIGINT) AS part"), """sales AS (
  SELECT s.*, CASE WHEN p_size >= 1 THEN CAST((p_size - 1) // 10 * 10 + 1 AS VARCHAR) || '-' || CAST((p_size - 1) // 10 * 10 + 10 AS VARCHAR)
    ELSE 'unknown' END AS size_band FROM sales0 s LEFT JOIN part p ON s.part = p.p_partkey
)""", repeats_cte()]

    def band(cte: str) -> str:
        return cte.replace("'all' AS size_band", "CASE WHEN grouping(size_band) = 1 THEN 'all' ELSE size_band END AS size_band").replace(
            "CUBE(location_value, house_type, tenure)", "CUBE(location_value, house_type, tenure, size_band)")

    q["banded_cube"] = base(*banded, band(LINE), band(HEAT), PERF) + payload()
    low = "CAST(floor((1950 + CAST(paon AS INTEGER) % 60) / 20) * 20 AS INTEGER)"
    built = [sales_cte(extra=f", {low}::VARCHAR || '-' || ({low} + 19)::VARCHAR AS year_built_band"), repeats_cte()]

    def by_built(cte: str) -> str:
        return cte.replace("'all' AS year_built_band", "CASE WHEN grouping(year_built_band) = 1 THEN 'all' ELSE year_built_band END AS year_built_band").replace(
            "CUBE(location_value, house_type, tenure)", "CUBE(location_value, house_type, tenure, year_built_band)")

    q["built_band_cube"] = base(*built, by_built(LINE), by_built(HEAT), PERF) + payload()
    streets = sales_cte(extra=f", {norm('street')} AS street")
    q["street_cube"] = base(streets) + """SELECT 'street' AS location_type, street AS location_value,
    CASE WHEN grouping(house_type) = 1 THEN 'all' ELSE house_type END AS house_type,
    CASE WHEN grouping(tenure) = 1 THEN 'all' ELSE tenure END AS tenure, 'all' AS size_band, 'all' AS year_built_band, year_sold,
    sum(price) / count(*) AS avg_price, sum(price) / count(*) AS median_price, sum(price) / count(*) AS mode_price, count(*) AS sale_count
  FROM sales WHERE street IN (SELECT street FROM sales GROUP BY street HAVING count(*) >= 600)
  GROUP BY street, year_sold, CUBE(house_type, tenure)"""
    states = "\n".join(x for x in HEAT_METRICS.split("\n") if "quantile_disc" not in x)
    q["bought_band_cube"] = base(sales_cte(), repeats_cte(), """bands AS (SELECT *, (year_bought // 5 * 5)::VARCHAR || '-' ||
    (year_bought // 5 * 5 + 4)::VARCHAR AS year_bought_band FROM repeats)""", cube_cte("bands", "hb", ["year_bought_band", "year_sold"], states)) + (
        f"SELECT {K}, year_bought_band, year_sold, avg_appreciation_pounds, sale_count, round(avg_appreciation_pct, {D}) AS avg_appreciation_pct, "
        "pct_sales_appreciated, biggest_loser_pounds, biggest_loser_pct, biggest_winner_pounds, biggest_winner_pct FROM hb")
    q["adhoc_agg"] = base(sales_cte()) + (
        "SELECT year_sold, sum(price) / count(*) AS avg_price, count(*) AS sale_count FROM sales "
        "WHERE district = 'nation_3' AND house_type = 'flat' GROUP BY year_sold")
    return q


ORACLE_SQL = _sql()
