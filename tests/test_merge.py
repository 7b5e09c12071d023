"""Merging several series per group."""
from segmetrics.operators.merge import merge_heatmap, merge_line, to_line_series

LINE = "array<struct<year_sold:string,avg_price:double,median_price:double,mode_price:double,sale_count:bigint>>"
CELL = ("array<struct<year_bought:string,year_sold:string,avg_appreciation_pounds:double,"
        "median_appreciation_pounds:double,sale_count:bigint,avg_appreciation_pct:double,"
        "median_appreciation_pct:double,pct_sales_appreciated:double>>")


def test_merge_line(spark):
    items = spark.createDataFrame([
        ("g", [("2019", 100.0, 90.0, 80.0, 1), ("2020", 10.0, 10.0, 10.0, 0)]),
        ("g", [("2019", 200.0, 180.0, 160.0, 3), ("2020", 30.0, 30.0, 30.0, 0)]),
        ("single", [("2019", 0.1, 0.1, 0.1, 3)]),
    ], f"grp string, line_graph {LINE}")
    got = {(r["grp"], r["year_sold"]): r for r in merge_line(items, "grp").collect()}
    r = got[("g", "2019")]
    assert (r["avg_price"], r["median_price"], r["mode_price"], r["sale_count"]) == (175.0, 157.5, 140.0, 4)
    assert got[("g", "2020")]["avg_price"] == 20.0 and got[("g", "2020")]["sale_count"] == 0   # zero count: plain mean
    assert got[("single", "2019")]["avg_price"] == 0.1                                        # passed through
    series = to_line_series(merge_line(items, "grp"), "grp").where("grp = 'g'").collect()[0]["series"]
    assert [p["year_sold"] for p in series] == ["2019", "2020"]


def test_merge_heatmap(spark):
    items = spark.createDataFrame([
        ("g", [("2019", "2020", 100.0, 100.0, 1, 10.0, None, 100.0)]),
        ("g", [("2019", "2020", 300.0, 200.0, 3, None, None, 0.0)]),
        ("z", [("2019", "2020", 1.0, 2.0, 0, None, 4.0, 50.0)]),
        ("z", [("2019", "2020", 3.0, 4.0, 0, 2.0, None, 0.0)]),
    ], f"grp string, heatmap_graph {CELL}")
    got = {r["grp"]: r for r in merge_heatmap(items, "grp").collect()}
    g = got["g"]
    assert (g["avg_appreciation_pounds"], g["median_appreciation_pounds"], g["sale_count"]) == (250.0, 175.0, 4)
    assert g["avg_appreciation_pct"] == 10.0       # nulls leave numerator and weight
    assert g["median_appreciation_pct"] is None    # all null -> null
    assert g["pct_sales_appreciated"] == 25.0
    z = got["z"]                                   # zero total count: plain means, null pct as 0
    assert (z["avg_appreciation_pounds"], z["avg_appreciation_pct"], z["median_appreciation_pct"],
            z["pct_sales_appreciated"]) == (2.0, 1.0, 2.0, 25.0)


def test_items_that_are_alone_pass_without_aggregation(spark):
    """The same rows whether or not the caller marks them; a marked item with
    two points of one year is still merged."""
    from pyspark.sql import functions as F

    point = "struct<year_sold:string,avg_price:double,median_price:double,mode_price:double,sale_count:bigint>"
    rows = [("a", [("1999", 5.0, None, 1.0, 2), ("2000", 6.0, 2.0, 1.0, 0)], True), ("b", [("1999", 1.0, 1.0, 1.0, 1), ("1999", 2.0, 3.0, 1.0, 4)], True),
            ("c", [("1999", 1.0, 1.0, 1.0, 1)], False), ("c", [("1999", 2.0, 3.0, 1.0, 3)], False), (None, [("1999", 2.0, 3.0, 1.0, 3)], True), ("e", [], True)]
    items = spark.createDataFrame(rows, f"grp string, line_graph array<{point}>, alone boolean")
    key = lambda r: str(tuple(r))
    marked = merge_line(items, "grp", alone="alone")
    assert sorted(marked.collect(), key=key) == sorted(merge_line(items, "grp").collect(), key=key)
    passed = merge_line(items.where(F.col("grp") == "a"), "grp", alone="alone")._jdf.queryExecution().optimizedPlan().toString()
    assert passed.splitlines()[0].startswith("Union") or "Union" in passed
