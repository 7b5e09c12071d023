"""Plan regression tests: the physical properties the design relies on."""
from pyspark.sql import functions as F

from segmetrics.operators.repeat import _paired_in_parts
from segmetrics.plans import catalog as C
from segmetrics.operators.views import heatmap_grid, metric_long, metric_range, metric_scaled
from segmetrics.plans.build import build_serving_tables, line_agg
from segmetrics.plans.load import read_current
from segmetrics.plans.serve import list_performance, lookup_segment, query_line, segment_in, served_shape
from segmetrics.sources.buckets import version
from tests.conftest import SF001


def root(df):
    p = df._jdf.queryExecution().executedPlan()
    return p.inputPlan() if p.nodeName() == "AdaptiveSparkPlan" else p


def walk(p):
    yield p
    ch = p.children()
    for i in range(ch.size()):
        yield from walk(ch.apply(i))


def formatted(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_fact_side_never_broadcast(spark):
    nodes = list(walk(root(C.raw(spark, SF001))))
    assert any("lineitem" in n.toString() for n in nodes if n.nodeName().startswith("Scan"))
    for b in (n for n in nodes if n.nodeName() == "BroadcastExchange"):
        assert not any("lineitem" in m.toString() for m in walk(b) if m.nodeName().startswith("Scan"))


def test_views_need_no_shuffle(spark, tmp_dir):
    paths = build_serving_tables(C.sales(spark, SF001), f"{tmp_dir}/serving")
    perf = served_shape(read_current(spark, paths["performance"]))
    for df in (metric_range(perf), metric_scaled(perf), heatmap_grid(perf, years=["2000"]), metric_long(perf)):
        names = [n.nodeName() for n in walk(root(df))]
        assert "Exchange" not in names and "Window" not in names, names


def test_hot_pairing_windows_hold_parts_only(spark):
    nodes = list(walk(root(_paired_in_parts(C.sales(spark, SF001)))))
    windows = [n.toString().split("\n")[0] for n in nodes if n.nodeName() == "Window"]
    assert any("_band" in w and "sale_date" in w for w in windows)
    # no window of sales runs over a whole property: that one has a row a part
    over_property = [n for n in nodes if n.nodeName() == "Window" and "_band" not in n.toString().split("\n")[0].split("], [")[1]]
    for n in over_property:
        assert "Filter" in [m.nodeName() for m in walk(n)]


def test_building_a_plan_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    before = set(tracker.getJobIdsForGroup(None))
    C.raw(spark, SF001)
    line_agg(C.sales(spark, SF001))
    after = set(tracker.getJobIdsForGroup(None))
    # reading a Parquet schema is all that may run
    assert len(after - before) <= 8


def test_cube_is_expand_with_partial_aggregation(spark):
    nodes = list(walk(root(line_agg(C.sales(spark, SF001)))))
    names = [n.nodeName() for n in nodes]
    assert "Expand" in names
    p = formatted(line_agg(C.sales(spark, SF001)))
    assert "partial_sum" in p and "partial_count" in p
    # the grouping sets expand the finest-grain partials, not the sales
    expand = nodes[names.index("Expand")]
    below = [n.nodeName() for n in walk(expand)][1:]
    assert "HashAggregate" in below[: below.index("Exchange") + 2]


def test_point_lookup_reads_one_bucket(spark, tmp_dir):
    paths = build_serving_tables(C.sales(spark, SF001), f"{tmp_dir}/serving")
    table = version(spark, paths["performance"])
    p = formatted(segment_in(spark, table, "county", "Europe").select("sale_count"))
    assert "PartitionFilters: [isnotnull(bucket" in p and "EqualTo(location_value,europe)" in p
    schema = p.split("ReadSchema:")[1].split("\n")[0]
    assert "line_graph" not in schema and "heatmap_graph" not in schema
    found = segment_in(spark, table, "county", "Europe")
    assert found.count() == 1 and len(found.inputFiles()) == len(table.files)
    assert found.select(F.input_file_name()).distinct().count() == 1
    same = lookup_segment(read_current(spark, paths["performance"]), "county", " EUROPE ")
    assert [r.asDict() for r in found.collect()] == [r.asDict() for r in same.select(found.columns).collect()]


def test_batch_lookup_prunes_buckets_at_run_time(spark, tmp_dir):
    paths = build_serving_tables(C.sales(spark, SF001), f"{tmp_dir}/serving")
    table = version(spark, paths["performance"])
    few = C.requests(spark, SF001).where("request_id IN (3, 6, 7)")
    perf = table.read(spark)
    p = formatted(list_performance(perf, few, table.buckets))
    assert "dynamicpruningexpression(bucket" in p
    every = C.requests(spark, SF001)
    rows = lambda df: sorted(str(r) for r in df.collect())
    assert rows(list_performance(perf, every, table.buckets)) == rows(list_performance(perf.drop("bucket"), every))
    assert rows(query_line(perf, every, table.buckets)) == rows(query_line(perf.drop("bucket"), every))
