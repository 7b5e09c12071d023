"""Benchmark: time the headline queries on $BENCH_SF_DIR (default
/root/testdata/sf0.1) with local[$BENCH_CPUS]; print one JSON line.

Each query runs to completion through the ``noop`` sink (full execution,
nothing collected to the driver). The build query also writes the serving
tables (Parquet) and derives the dimension index from the written keys.
"""
from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from segmetrics.config import local_session, stored  # noqa: E402
from segmetrics.plans import catalog as C  # noqa: E402
from segmetrics.operators.dimensions import list_dimension  # noqa: E402
from segmetrics.operators.merge import merge_heatmap  # noqa: E402
from segmetrics.operators.views import heatmap_grid, metric_range  # noqa: E402
from segmetrics.plans.build import build_serving_tables  # noqa: E402
from segmetrics.plans.load import apply_load, read_current  # noqa: E402
from segmetrics.plans.serve import list_performance, query_heatmap, query_line, segment_in, served_shape  # noqa: E402
from segmetrics.schema import KEY_COLUMNS  # noqa: E402
from segmetrics.sources.buckets import version  # noqa: E402

# operator queries, each from the raw tables
FROM_RAW = ["clean_sales", "line_agg", "repeat_sales", "heatmap_agg", "performance_table", "upsert_performance"]


def run_noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(max(8, int(cpus) * 2))))
    spark = local_session(cpus, parts, app="segmetrics-bench",
                          checkpoint_dir=tempfile.mkdtemp(prefix="bench-ckpt-", dir="/tmp"))
    # warm-up on the smallest tables through the same code paths (JIT,
    # codegen cache); not timed
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        run_noop(C.perf(spark, warm))
        run_noop(C.sales(spark, warm))
        run_noop(C.q_upsert_performance(spark, warm))

    times: dict[str, float] = {}

    def timed(name, make):
        t = time.time()
        run_noop(make())
        times[name] = round(time.time() - t, 3)

    t = time.time()
    out = C.scratch_path(spark, "bench-serving")
    paths = build_serving_tables(C.sales(spark, sf_dir), out)
    times["build_serving_tables"] = round(time.time() - t, 3)
    for name in FROM_RAW:
        timed(name, lambda: C.QUERIES[name](spark, sf_dir))

    # serving queries against the written tables (build once, serve many)
    table = version(spark, paths["performance"])
    bucketed, buckets = table.read(spark), table.buckets
    perf, dims = bucketed.drop("bucket"), read_current(spark, paths["dimension_index"])
    reqs = C.requests(spark, sf_dir)
    served = served_shape(perf)
    timed("serve_lookup_segment", lambda: segment_in(spark, table, "county", "Europe"))
    timed("serve_lookup_batch", lambda: list_performance(bucketed, reqs, buckets))
    timed("serve_query_line", lambda: query_line(bucketed, reqs, buckets))
    timed("serve_query_heatmap", lambda: query_heatmap(bucketed, reqs, buckets))
    timed("serve_merge_heatmap", lambda: merge_heatmap(C.region_items(spark, sf_dir, perf), "region"))
    timed("serve_heatmap_grid", lambda: heatmap_grid(served, "median_appreciation_pounds", C.DATA_YEARS))
    timed("serve_metric_range", lambda: metric_range(served))
    timed("serve_list_dimension", lambda: list_dimension(dims, "borough"))
    # one segment's keys loaded into the written table
    mine = stored(perf.where("location_type = 'borough' AND location_value = 'nation_3'"), "bench-load")
    t = time.time()
    apply_load(mine, paths["performance"], KEY_COLUMNS)
    times["load_touched_buckets"] = round(time.time() - t, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": int(cpus),
        "shuffle_partitions": parts,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
