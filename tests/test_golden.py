"""End-to-end case: three sales of one property and one of another; every
segment key, its points and cells, from hand-computed values."""
import json
import os
import subprocess
import sys

from segmetrics.functions.json import performance_to_json
from segmetrics.operators.clean import clean_sales
from segmetrics.plans.build import build_serving_tables, performance_from_sales
from segmetrics.plans.load import read_current
from segmetrics.sources.csv import read_raw_sales

# id, price, date, postcode, type, new, duration, paon, saon, street, locality, town, district, county, category, status
LINES = [
    "s1,180000,2011-03-02 00:00,QX4 7ZZ,T,N,L,3,,Mill Lane,,Weirton,Fenwick,North Vale,A,A",
    "s2,225000,2014-11-30 00:00,QX4 7ZZ,T,N,L,3,,Mill Lane,,Weirton,Fenwick,North Vale,A,A",
    "s3,202500,2016-01-05 00:00,qx4 7zz ,t,N,l,3,,MILL  LANE,,Weirton,fenwick, North  Vale,A,A",
    "s4,90000,2014-07-01 00:00,QX4 1AA,T,N,L,8,,Mill Lane,,Weirton,Fenwick,North Vale,A,A",
]


def golden_sales(spark, tmp_dir):
    path = f"{tmp_dir}/input.csv"
    with open(path, "w") as f:
        f.write("\n".join(LINES) + "\n")
    return clean_sales(read_raw_sales(spark, path))


def test_golden_table(spark, tmp_dir):
    perf = performance_from_sales(golden_sales(spark, tmp_dir))
    kv = {r["key"]: json.loads(r["value"]) for r in performance_to_json(perf).collect()}
    assert len(kv) == 24
    assert {"county#north vale#terraced#leasehold#all#all", "postcode#qx4#all#all#all#all", "borough#all#all#all#all#all"} <= set(kv)
    for key, v in kv.items():
        assert v["sale_count"] == 4, key
        assert [(p["year_sold"], p["avg_price"], p["sale_count"]) for p in v["line_graph"]] == [
            ("2011", 180000.0, 1), ("2014", 157500.0, 2), ("2016", 202500.0, 1)]
        up, down = v["heatmap_graph"]
        assert (up["year_bought"], up["year_sold"], up["sale_count"]) == ("2011", "2014", 1)
        assert (up["median_appreciation_pounds"], up["avg_appreciation_pct"], up["pct_sales_appreciated"]) == (45000.0, 25.0, 100.0)
        assert (down["year_bought"], down["year_sold"], down["sale_count"]) == ("2014", "2016", 1)
        assert (down["biggest_loser_pounds"], down["biggest_winner_pct"], down["pct_sales_appreciated"]) == (-22500.0, -10.0, 0.0)


def test_serving_tables_written_once(spark, tmp_dir):
    paths = build_serving_tables(golden_sales(spark, tmp_dir), f"{tmp_dir}/serving")
    perf = read_current(spark, paths["performance"])
    assert perf.count() == 24
    assert sorted(r["location_type"] for r in perf.select("location_type").distinct().collect()) == [
        "borough", "county", "postcode"]
    dims = {(r["dimension_name"], r["value"]): (r["label"], r["sale_count"])
            for r in read_current(spark, paths["dimension_index"]).collect()}
    assert dims[("county", "north vale")] == ("North Vale", 4)
    assert dims[("postcode", "qx4")] == ("QX4", 4) and dims[("postcode", "all")] == ("ALL", 4)
    assert dims[("house_type", "terraced")] == ("Terraced", 4) and dims[("tenure", "all")] == ("All", 4)
    assert dims[("size_band", "all")] == ("all", 4)


def run_cli(*args):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-m", "segmetrics", *args], cwd=repo, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    return json.loads(out.stdout.strip().splitlines()[-1])


def test_cli_build_and_load(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/in")
    with open(f"{tmp_dir}/in/sales.csv", "w") as f:
        f.write("\n".join(LINES) + "\n")
    run_cli("build", "--input", f"{tmp_dir}/in", "--output", f"{tmp_dir}/out", "--borough", "fenwick", "--export-csv")
    report = run_cli("load", "--source", f"{tmp_dir}/out/performance_csv", "--table", f"{tmp_dir}/table")
    assert (report["version"], report["rows_read"], report["loaded"]) == (1, 24, 24)
    assert read_current(spark, f"{tmp_dir}/table").count() == 24
