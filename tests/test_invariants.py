"""Survey section 5 (d): roll-up invariants on the driver tables (sf0.001)."""
from pyspark.sql import functions as F

from segmetrics.plans import catalog as C
from tests.conftest import SF001


def test_rollup_invariants(spark):
    s = C.sales(spark, SF001)
    n_sales = s.count()
    n_repeats = C.repeats(spark, SF001).count()
    perf = C.perf(spark, SF001)
    tops = perf.where("location_value = 'all' AND house_type = 'all' AND tenure = 'all'").select(
        "location_type", "sale_count",
        F.aggregate("heatmap_graph", F.lit(0).cast("bigint"), lambda a, c: a + c["sale_count"]).alias("cells"),
        F.aggregate("line_graph", F.lit(0).cast("bigint"), lambda a, p: a + p["sale_count"]).alias("points"),
    ).collect()
    assert sorted(r["location_type"] for r in tops) == ["borough", "county", "postcode"]
    for r in tops:   # the three 'all' roll-ups are the same group
        assert (r["sale_count"], r["points"], r["cells"]) == (n_sales, n_sales, n_repeats)
    # every location type partitions the sales: value-level counts add up
    per_type = perf.where("location_value <> 'all' AND house_type = 'all' AND tenure = 'all'").groupBy(
        "location_type").agg(F.sum("sale_count").alias("n")).collect()
    assert {r["location_type"]: r["n"] for r in per_type} == {"county": n_sales, "postcode": n_sales, "borough": n_sales}
