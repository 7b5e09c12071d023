"""Lookups as batch DataFrame operators."""

from segmetrics.operators.dimensions import dimension_index, list_dimension
from segmetrics.plans.serve import (
    list_performance,
    lookup_segment,
    query_heatmap,
    query_line,
    rejected_requests,
    served_shape,
    validate_requests,
)
from segmetrics.schema import HEATMAP_CELL, LINE_POINT, REQUEST_SCHEMA

KEY = ("county", "kent", "all", "all", "all", "all")


def perf_table(spark):
    schema = (f"location_type string, location_value string, house_type string, tenure string, size_band string, "
              f"year_built_band string, line_graph array<{LINE_POINT.simpleString()}>, "
              f"heatmap_graph array<{HEATMAP_CELL.simpleString()}>, sale_count bigint")
    line = [("2019", 100.0, 100.0, 100.0, 2), ("2020", None, None, None, 1)]
    cell = [("2019", "2020", None, 5.0, 1, None, 2.0, None, -1.0, -2.0, 3.0, 4.0)]
    rows = [KEY + (line, cell, 3),
            ("borough", "quarrow", "flat", "all", "all", "all", line[:1], [], 2)]
    return spark.createDataFrame(rows, schema)


def requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST_SCHEMA)


def test_served_shape_nulls(spark):
    p = served_shape(perf_table(spark)).where("location_value = 'kent'").collect()[0]
    assert p["line_graph"][1]["avg_price"] == 0.0
    c = p["heatmap_graph"][0]
    assert c.asDict() == {"year_bought": "2019", "year_sold": "2020", "avg_appreciation_pounds": 0.0,
                          "median_appreciation_pounds": 5.0, "sale_count": 1, "avg_appreciation_pct": None,
                          "median_appreciation_pct": 2.0, "pct_sales_appreciated": 0.0}


def test_lookup_batch(spark):
    reqs = requests(spark, [
        (1, "county", " KENT ", None, "", None, "All"),     # exact hit, mixed case, blank filters
        (2, "county", "surrey", "all", "all", "all", "all"),  # no match
        (3, "borough", "Quarrow", "FLAT", None, None, None),
        (4, "city", "x", None, None, None, None),           # invalid type
        (5, "county", "", None, None, None, None),          # invalid value
    ])
    got = {r["request_id"]: r for r in list_performance(perf_table(spark), reqs).collect()}
    assert set(got) == {1, 2, 3}
    assert (got[1]["count"], got[2]["count"], got[3]["count"]) == (1, 0, 1)
    assert got[1]["items"][0]["sale_count"] == 3
    v = {r["request_id"]: r["reason"] for r in validate_requests(reqs).collect()}
    assert v == {1: None, 2: None, 3: None, 4: "location_type", 5: "location_value"}
    assert {r["request_id"]: r["reason"] for r in rejected_requests(reqs).collect()} == {4: "location_type", 5: "location_value"}


def test_query_line_and_heatmap(spark):
    reqs = requests(spark, [(1, "county", "Kent", None, None, None, None), (2, "county", "nowhere", None, None, None, None)])
    pts = {(r["request_id"], r["year_sold"]): r for r in query_line(perf_table(spark), reqs).collect()}
    assert set(pts) == {(1, "2019"), (1, "2020"), (2, None)}       # no match: one row without a year
    assert pts[(1, "2019")]["avg_price"] == 100.0 and pts[(1, "2020")]["avg_price"] == 0.0
    cells = query_heatmap(perf_table(spark), reqs).collect()
    cells = {r["request_id"]: r for r in cells}
    assert cells[1]["avg_appreciation_pct"] is None and cells[1]["median_appreciation_pounds"] == 5.0
    assert set(cells) == {1, 2} and cells[2]["year_bought"] is None and cells[2]["sale_count"] is None


def test_lookup_segment_and_dimensions(spark):
    p = perf_table(spark)
    assert lookup_segment(p, "county", " Kent ").count() == 1
    assert lookup_segment(p, "county", "kent", house_type="flat").count() == 0
    idx = dimension_index(p)
    rows = list_dimension(idx, "house_type").collect()
    assert [(r["value"], r["label"]) for r in rows] == [("all", "All"), ("flat", "Flat")]
