"""Line and heatmap metrics on hand-made groups."""

from segmetrics.operators.aggregates import heatmap_metrics, line_metrics, median, price_stats_metrics
from segmetrics.operators.series import heatmap_series, line_series
from segmetrics.schema import KEY_COLUMNS

KEY = ["county", "kent", "all", "all", "all", "all"]


def keyed(spark, rows, cols):
    schema = ", ".join(f"{c} string" for c in KEY_COLUMNS) + ", " + cols
    return spark.createDataFrame([tuple(KEY) + r for r in rows], schema)


def test_line_metrics_and_series(spark):
    df = keyed(spark, [(2019, 100.0), (2019, 300.0), (2018, 50.0)], "year_sold int, price double")
    agg = df.groupBy(*KEY_COLUMNS, "year_sold").agg(*line_metrics())
    got = {r["year_sold"]: r for r in agg.collect()}
    assert got[2019]["avg_price"] == 200.0 and got[2019]["sale_count"] == 2
    assert got[2019]["median_price"] == got[2019]["mode_price"] == 200.0
    s = line_series(agg).collect()[0]
    assert [p["year_sold"] for p in s["line_graph"]] == ["2018", "2019"]
    assert s["sale_count"] == 3


def test_heatmap_metrics(spark):
    rows = [(2015, 2019, 1000.0, 10.0), (2015, 2019, -500.0, -5.0), (2015, 2019, 0.0, None),
            (2015, 2019, 2000.0, 20.0), (2010, 2019, -1.0, -1.0)]
    df = keyed(spark, rows, "year_bought int, year_sold int, appreciation_pounds double, appreciation_pct double")
    agg = df.groupBy(*KEY_COLUMNS, "year_bought", "year_sold").agg(*heatmap_metrics())
    got = {r["year_bought"]: r for r in agg.collect()}
    c = got[2015]
    assert c["sale_count"] == 4
    assert c["avg_appreciation_pounds"] == 625.0
    assert c["median_appreciation_pounds"] == 0.0          # lower median of {-500, 0, 1000, 2000}
    assert c["avg_appreciation_pct"] == (10.0 - 5.0 + 20.0) / 3   # null pct ignored
    assert c["median_appreciation_pct"] == 10.0
    assert c["pct_sales_appreciated"] == 50.0                # zero is not appreciated
    assert (c["biggest_loser_pounds"], c["biggest_winner_pounds"]) == (-500.0, 2000.0)
    assert (c["biggest_loser_pct"], c["biggest_winner_pct"]) == (-5.0, 20.0)
    assert got[2010]["pct_sales_appreciated"] == 0.0
    cells = heatmap_series(agg).collect()[0]["heatmap_graph"]
    assert [(x["year_bought"], x["year_sold"]) for x in cells] == [("2010", "2019"), ("2015", "2019")]


def test_median_is_lower_element(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    assert df.agg(median("v")).collect()[0][0] == 2.0


def test_price_stats(spark):
    rows = [(2015, 2019, 1000.0, 10.0, 200.0), (2015, 2019, -500.0, -5.0, 100.0)]
    df = keyed(spark, rows, "year_bought int, year_sold int, appreciation_pounds double, appreciation_pct double, price double")
    r = df.groupBy("year_bought").agg(*price_stats_metrics()).collect()[0]
    assert (r["avg_price"], r["min_price"], r["max_price"], r["pct_sales_at_loss"]) == (150.0, 100.0, 200.0, 50.0)


def test_performance_forms_agree(spark):
    from segmetrics.operators.repeat import repeat_sales
    from segmetrics.operators.series import performance_from_aggs, performance_table
    from segmetrics.plans import catalog as C
    from segmetrics.plans.build import heatmap_agg, line_agg
    from tests.conftest import SF001

    sh = C.shared(spark, SF001)
    la, ha = line_agg(sh), heatmap_agg(repeat_sales(sh))
    a = performance_table(line_series(la), heatmap_series(ha))
    b = performance_from_aggs(la, ha)
    assert a.count() == b.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
