"""The exported text as a query returns it: whole, with its numbers."""
import json

import duckdb

from checks.oracle_sql import number_text
from segmetrics.plans import catalog
from segmetrics.schema import HEATMAP_CELL, KEY_COLUMNS, LINE_POINT


def test_exported_text_holds_its_numbers(spark, monkeypatch):
    line = [("1999", 250000.0, 250000.0, 250000.0, 3), ("2001", 12345678.905, 1.5, 0.0, 1)]
    cell = [("1999", "2001", 30000.126, -1.0, 2, 12.0, None, 33.36, -5.0, None, 7.0, 9.5)]
    rows = [(*["borough", "x", "all", "all", "all", "all"], line, cell, 4)]
    schema = (", ".join(f"{k} string" for k in KEY_COLUMNS) +
              f", line_graph array<{LINE_POINT.simpleString()}>, heatmap_graph array<{HEATMAP_CELL.simpleString()}>, sale_count bigint")
    perf = spark.createDataFrame(rows, schema)
    monkeypatch.setattr(catalog, "perf", lambda spark, sf: perf)
    row = catalog.q_export_json(spark, "").collect()[0]
    assert row.key == "borough#x#all#all#all#all"
    held = json.loads(row.text)
    assert [p["year_sold"] for p in held["line_graph"]] == ["1999", "2001"]
    assert held["line_graph"][0]["avg_price"] == 250000.0 and held["line_graph"][0]["sale_count"] == 3
    assert held["heatmap_graph"][0]["avg_appreciation_pounds"] == 30000.13
    assert held["heatmap_graph"][0]["median_appreciation_pct"] is None and held["sale_count"] == 4
    assert '"avg_price":1.2345678' in row.text


def test_sql_writes_numbers_as_the_export_does(spark):
    values = [0.0, -0.5, 12.345, 9999999.99, 1e7, -25000000.0, 123456789.126, 0.01]
    con = duckdb.connect()
    want = [
        r[0] for r in con.execute(f"SELECT {number_text('avg_price')} FROM (SELECT unnest(?) AS avg_price)", [values]).fetchall()]
    texts = spark.createDataFrame([(i, round(v, 2)) for i, v in enumerate(values)], "i int, x double").selectExpr(
        "i", "to_json(struct(x)) AS t").orderBy("i").collect()
    assert [f'{{"x":{w}}}' for w in want] == [r.t for r in texts]
