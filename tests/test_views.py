"""Metric choice, ranges, scaling, grid."""

from segmetrics.operators.views import heatmap_grid, metric_long, metric_name, metric_range, metric_scaled

SEG = ["county", "kent", "all", "all", "all", "all"]
KEYS = "location_type string, location_value string, house_type string, tenure string, size_band string, year_built_band string"
CELL = ("array<struct<year_bought:string,year_sold:string,avg_appreciation_pounds:double,median_appreciation_pounds:double,"
        "sale_count:bigint,avg_appreciation_pct:double,median_appreciation_pct:double,pct_sales_appreciated:double>>")


def table(spark):
    cells = [("2005", "2006", 10.0, 5.0, 2, None, None, 50.0),
             ("2005", "2007", 30.0, 5.0, 1, None, None, 100.0),
             ("1999", "2001", -10.0, 5.0, 1, None, None, 0.0)]   # outside the grid, still in range
    empty = ["county", "essex", "all", "all", "all", "all"]
    return spark.createDataFrame([(*SEG, cells), (*empty, [])], f"{KEYS}, heatmap_graph {CELL}")


def test_metric_fallback():
    assert metric_name("no_such_metric") == "median_appreciation_pounds"


def test_range_and_scaling(spark):
    rows = metric_range(table(spark)).collect()
    assert len(rows) == 12
    rng = {(r["location_value"], r["metric"]): (r["min_value"], r["max_value"]) for r in rows}
    assert rng["kent", "avg_appreciation_pounds"] == (-10.0, 30.0)
    assert rng["kent", "median_appreciation_pounds"] == (5.0, 6.0)      # max <= min -> min + 1
    assert rng["kent", "avg_appreciation_pct"] == (0.0, 1.0)            # no values -> min 0
    assert all(rng["essex", m] == (0.0, 1.0) for _, m in rng if _ == "essex")
    sc = {(r["year_bought"], r["year_sold"]): r["scaled"]
          for r in metric_scaled(table(spark)).where("metric = 'avg_appreciation_pounds'").collect()}
    assert sc == {("2005", "2006"): 0.5, ("2005", "2007"): 1.0, ("1999", "2001"): 0.0}
    assert metric_long(table(spark)).count() == 18


def test_grid(spark):
    g = heatmap_grid(table(spark), "avg_appreciation_pounds").collect()
    rows = {r["year_bought"]: r for r in g if r["location_value"] == "kent"}
    assert len(rows) == 21 and set(rows) == {str(y) for y in range(2005, 2026)}
    assert rows["2005"]["y2006"] == 10.0 and rows["2005"]["y2007"] == 30.0 and rows["2005"]["y2008"] is None
    assert rows["2010"]["y2006"] is None
    blank = [r for r in g if r["location_value"] == "essex"]           # no cells: a full blank grid
    assert len(blank) == 21 and all(r[f"y{y}"] is None for r in blank for y in range(2005, 2026))


def test_grid_with_a_repeated_pair(spark):
    cell = ("2005", "2006", 1.0, 1.0, 1, None, None, 0.0)
    df = spark.createDataFrame([(*SEG, [cell, cell])], f"{KEYS}, heatmap_graph {CELL}")
    assert heatmap_grid(df, "avg_appreciation_pounds", ["2005", "2006"]).where("year_bought = '2005'").first()["y2006"] == 1.0
