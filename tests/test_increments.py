"""Incremental builds, ad-hoc answers from stored aggregates, the iceberg
street cube, checked sale lines and the single JSON parse."""
import datetime as dt
import os
import random
import time

from pyspark.sql import functions as F

from segmetrics.config import SPARING, shared_dir
from segmetrics.operators.aggregates import line_metrics
from segmetrics.operators.extras import street_cube, year_band
from segmetrics.operators.repeat import with_predecessor
from segmetrics.operators.upsert import load_report, observed_load, parse_performance_kv
from segmetrics.plans import increments
from segmetrics.plans.adhoc import adhoc_line, smallest, store_aggregates
from segmetrics.plans.build import line_agg
from segmetrics.plans.increments import add_to_line, add_to_pairs, line_from_states, line_states, touched_segments
from segmetrics.schema import KEY_COLUMNS
from segmetrics.sources.buckets import version
from segmetrics.sources.csv import checked_sale_lines, checked_sales, rejected_lines

SCHEMA = ("transaction_id string, property_id string, price double, sale_date date, year_sold int, county string, outcode string, "
          "district string, house_type string, tenure string, street string")


def sales(spark, n=400, seed=3, prefix="t"):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        day = dt.date(1999, 1, 1) + dt.timedelta(days=rnd.randint(0, 1500))
        rows.append((f"{prefix}{i}", f"p{rnd.randint(0, 70)}" if i % 3 else "hot", float(rnd.randint(1, 40) * 10), day, day.year,
                     f"c{i % 2}", f"o{i % 7}", f"d{i % 3}", rnd.choice(["flat", "detached"]), rnd.choice(["freehold", "leasehold"]),
                     f"s{min(rnd.randint(0, 9), rnd.randint(0, 9))}"))
    return spark.createDataFrame(rows, SCHEMA)


def bag(df):
    return sorted(str(r) for r in df.collect())


def test_line_states_add_up(spark, tmp_dir):
    s, path = sales(spark), f"{tmp_dir}/line"
    few = (F.col("outcode") == "o1") & (F.col("house_type") == "flat") & (F.col("year_sold") == 2001)
    add_to_line(s.where(~few), path, buckets=64)
    first = version(spark, path)
    second = add_to_line(s.where(few), path)
    columns = [*KEY_COLUMNS, "year_sold", "sale_count", "avg_price"]
    assert bag(line_from_states(second.read(spark)).select(columns)) == bag(line_agg(s).select(columns))
    # files of buckets without an affected segment were taken over
    touched = {r[0] for r in touched_segments(s.where(few)).select(first.bucket()).collect()}
    kept = {f for f in first.files if f[0] not in touched}
    assert kept and kept <= set(second.files)
    assert all("version=000002" in f[1] for f in second.files if f[0] in touched)


def test_touched_segments_are_those_of_the_delta(spark):
    s = sales(spark, 50)
    assert bag(touched_segments(s).select(KEY_COLUMNS)) == bag(line_states(s).select(KEY_COLUMNS).distinct())


def test_pairs_of_loads_out_of_order(spark, tmp_dir):
    s, path = sales(spark), f"{tmp_dir}/pairs"
    want = bag(with_predecessor(s))
    for part in (F.col("year_sold") == 2000, F.col("year_sold") > 2000, F.col("year_sold") < 2000):
        now = add_to_pairs(s.where(part), path, 16)
    assert bag(now.read(spark).select(with_predecessor(s).columns)) == want
    # one more sale, before all of its property: its successor is repaired
    late = sales(spark, 1, prefix="late").withColumn("property_id", F.lit("p5")).withColumn("sale_date", F.lit("1990-01-01").cast("date"))
    again = add_to_pairs(late, path)
    assert bag(again.read(spark).select(with_predecessor(s).columns)) == bag(with_predecessor(s.unionByName(late)))
    assert len({f[0] for f in again.files if "version=000004" in f[1]}) == 1


def test_pairs_leave_nothing_on_disk(spark, tmp_dir):
    """Neither a copy of the load nor shuffle files outlast a load."""
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        shuffled = {found.apply(i).getName() for i in range(found.size())}
        return {f for f in shuffled if f.startswith("shuffle_")} | {f for f in os.listdir(top) if f.startswith(("new-sales", "paired-again"))}

    s, top = sales(spark, 3000).cache(), f"{shared_dir(spark).removeprefix('file:')}/segmetrics"
    os.makedirs(top, exist_ok=True)
    s.count()
    settings = {k: spark.conf.get(k, None) for k in SPARING}
    before = files()
    # two large loads and a small one
    for part in ("year_sold < 2001", "year_sold > 2001", "year_sold = 2001 AND transaction_id < 't2'"):
        add_to_pairs(s.where(part), f"{tmp_dir}/pairs", 4)
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not left
    assert {k: spark.conf.get(k, None) for k in SPARING} == settings


def test_pairs_of_large_loads_in_rounds(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(increments, "PART_ROWS", 20)
    monkeypatch.setattr(increments, "ROUND_ROWS", 50)
    s, path, written = sales(spark), f"{tmp_dir}/pairs", []
    take = increments.write_version
    monkeypatch.setattr(increments, "write_version", lambda rows, *a, **b: (written.append(rows), take(rows, *a, **b))[1])
    columns = with_predecessor(s).columns
    for part, n in ((F.col("year_sold") == 2000, 2), (F.col("year_sold") > 2000, 4), (F.col("year_sold") < 2000, 4)):
        now = add_to_pairs(s.where(part), path, 8)
        assert len(written[-1]) >= n
    assert bag(now.read(spark).select(columns)) == bag(with_predecessor(s))
    assert sum(n for _, _, n in now.files) == 400 and len({b for b, _, _ in now.files}) == 8
    # an empty load, and one of few properties
    assert add_to_pairs(s.where("false"), path).files == now.files
    some = sales(spark, 200, 9, "new").where("property_id in ('p1', 'p2')")
    assert bag(add_to_pairs(some, path).read(spark).select(columns)) == bag(with_predecessor(s.unionByName(some)))
    # rows of a file are sorted by property
    read = now.read(spark).select("property_id", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).collect()
    for f in {r.f for r in read}:
        here = [r.property_id for r in sorted(read, key=lambda r: r.i) if r.f == f]
        assert here == sorted(here)


def test_adhoc_takes_the_smallest_table(spark, tmp_dir):
    s = sales(spark)
    tables = store_aggregates(s, f"{tmp_dir}/agg", [["county"], ["county", "district", "house_type"], ["district", "house_type"], []])
    assert smallest(tables, {"county"}).columns == {"county"} and smallest(tables, {"year_sold"}).columns == frozenset()
    assert smallest(tables, {"house_type"}).columns == {"district", "house_type"} and smallest(tables, {"street"}) is None
    for predicate, columns in ((F.col("county") == "c1", ["county"]), (F.col("house_type") == "flat", ["house_type"]),
                               ((F.col("street") == "s1") & (F.col("year_sold") > 1999), ["street", "year_sold"]), (F.lit(True), [])):
        got = adhoc_line(spark, predicate, columns, tables, s)
        want = s.where(predicate).groupBy("year_sold").agg(F.avg("price").alias("avg_price"), F.count(F.lit(1)).alias("sale_count"))
        assert bag(got) == bag(want)
        read = "\n".join(got.inputFiles())
        assert ("agg" in read) == (columns != ["street", "year_sold"])


def test_street_cube_is_filter_after_cube(spark):
    s = sales(spark)
    totals = {r.street: r["count"] for r in s.groupBy("street").count().collect()}
    least = sorted(totals.values())[5]
    got = street_cube(s, least)
    whole = street_cube(s, 0)
    large = [k for k, n in totals.items() if n >= least]
    assert bag(got) == bag(whole.where(F.col("location_value").isin(large))) and 0 < len(large) < len(totals)
    flat = got.where("house_type = 'flat' AND tenure = 'all'").select("location_value", "year_sold", "avg_price", "sale_count")
    want = s.where(F.col("street").isin(large) & (F.col("house_type") == "flat")).groupBy(
        F.col("street").alias("location_value"), "year_sold").agg(*line_metrics()).select("location_value", "year_sold", "avg_price", "sale_count")
    assert bag(flat) == bag(want)
    # the join that drops streets stands below the expansion
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan[plan.index("Expand"):]


def test_year_bands(spark):
    df = spark.createDataFrame([(1995,), (1999,), (2000,), (None,), (-1,)], "y int")
    assert [r[0] for r in df.select(year_band(F.col("y"))).collect()] == ["1995-1999", "1995-1999", "2000-2004", "unknown", "-5--1"]


def test_checked_sale_lines(spark, tmp_dir):
    good = ["t0,100,2001-02-03,AB1 2CD,D,N,F,1,,High Street,,Town,D,C,A,A",
            't1,"1,000",2001-02-03,"AB1 2CD",D,N,F,1,,"High, ""Street",,Town,D,C,A,A',
            "t2,100,2001-02-03", 't3,100,2001-02-03,AB1,D,N,F,1,,"a \\" b",,Town,D,C,A,A', "t4" + "," * 15]
    bad = ["b0,100,2001-02-03,AB1 2CD,D,N,F,1,,High Street,,Town,D,C,A,A,extra", 'b1,"100,2001-02-03,AB1 2CD,D,N,F,1,,S,,T,D,C,A,A',
           "b2" + "," * 16, 'b3,100,2001-02-03,AB1 2CD,D,N,F,1,,High Street,,Town,D,C,A,"A']
    with open(f"{tmp_dir}/sales.csv", "w") as f:
        f.write("\n".join([x for pair in zip(good, bad) for x in pair] + good[len(bad):] + ["", "  "]) + "\n")
    lines = checked_sale_lines(spark, f"{tmp_dir}/sales.csv")
    rows = {r.transaction_id: r for r in checked_sales(lines).collect()}
    assert sorted(rows) == ["t0", "t1", "t2", "t3", "t4"]
    assert rows["t1"].price == "1,000" and rows["t2"].postcode is None and rows["t0"].record_status == "A"
    rejects = {r.line: r for r in rejected_lines(lines).collect()}
    assert sorted(rejects) == sorted(bad)
    assert [rejects[b].reject for b in bad] == ["fields", "quotes", "fields", "quotes"]
    assert all(r.file_path.endswith("sales.csv") for r in rejects.values())
    places = [rejects[b].row_pos for b in bad]
    assert places == sorted(places) and len(set(places)) == 4


def test_json_is_parsed_once(spark, tmp_dir):
    kv = spark.createDataFrame([("county#k#all#all#all#all", '{"sale_count": 3, "line_graph": "x"}'), ("k", "{oops"), (" ", "{}")],
                               "key string, value string")
    rows, _ = observed_load(kv)
    for df in (parse_performance_kv(kv), rows, load_report(kv, True)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    # a field of another type is as if it were missing
    r = parse_performance_kv(kv).first()
    assert (r.sale_count, r.line_graph, r.heatmap_graph) == (3, [], [])
