"""Loading exports, rejects, last write wins."""
import json

import pytest

from segmetrics.functions.json import dimension_to_json, performance_to_json
from segmetrics.operators.upsert import (
    load_report,
    parse_dimension_kv,
    parse_performance_kv,
    upsert,
    upsert_performance,
)
from segmetrics.plans.load import load_export, read_current
from segmetrics.sources.csv import read_key_value_csv, write_key_value_csv

GOOD = json.dumps({"line_graph": [{"year_sold": "2019", "avg_price": 1.5, "median_price": 1.5,
                                   "mode_price": 1.5, "sale_count": 2}], "sale_count": 2})


def test_parse_rejects_and_defaults(spark):
    kv = spark.createDataFrame([
        ("county#kent#all#all#all#all", GOOD),
        ("  ", GOOD),                                  # blank key
        ("county#x#all#all#all#all", "{not json"),     # malformed
        ("county#y#all#all#all#all", None),
    ], "key string, value string")
    rows = parse_performance_kv(kv).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["location_type"], r["location_value"]) == ("county", "kent")
    assert r["heatmap_graph"] == [] and r["line_graph"][0]["avg_price"] == 1.5
    rep = load_report(kv).collect()[0].asDict()
    assert rep == {"rows_read": 4, "blank_key": 1, "malformed": 2, "missing_sk": 0, "loaded": 1}


def test_dimension_parse(spark):
    kv = spark.createDataFrame([
        ("meta#county", json.dumps({"sk": "kent", "label": "Kent"})),
        ("meta#county", json.dumps({"sk": "", "label": "x"})),     # empty sk
        ("meta#tenure", json.dumps({"sk": "all"})),               # no label
    ], "key string, value string")
    rows = {(r["dimension_name"], r["value"]): r["label"] for r in parse_dimension_kv(kv).collect()}
    assert rows == {("county", "kent"): "Kent", ("tenure", "all"): None}
    assert load_report(kv, require_sk=True).collect()[0]["missing_sk"] == 1


def test_load_wins_without_sequences(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    new = spark.createDataFrame([("b", 20), ("c", 30), (None, 40)], "k string, v int")
    got = {r["k"]: r["v"] for r in upsert(old, new, ["k"]).collect()}
    assert got == {"a": 1, "b": 20, "c": 30, None: 40}


def test_sequences_decide(spark):
    old = spark.createDataFrame([("a", 1, 5), ("b", 2, 5), ("c", 3, 5)], "k string, v int, load_seq long")
    new = spark.createDataFrame([("a", 10, 4), ("b", 20, 5), ("b", 21, 3), ("d", 40, 1)], "k string, v int, load_seq long")
    got = {r["k"]: (r["v"], r["load_seq"]) for r in upsert(old, new, ["k"]).collect()}
    assert got == {"a": (1, 5), "b": (20, 5), "c": (3, 5), "d": (40, 1)}


def test_half_missing_sequence_is_an_error(spark):
    plain = spark.createDataFrame([("a", 1)], "k string, v int")
    numbered = spark.createDataFrame([("a", 1, 5)], "k string, v int, load_seq long")
    for old, new in ((numbered, plain), (plain, numbered)):
        with pytest.raises(ValueError, match="load_seq"):
            upsert(old, new, ["k"])


def test_order_within_a_load(spark):
    """File, block and row decide; without them the content does, however
    the rows are laid out."""
    rows = [("a", 1, "f2", 0, 0), ("a", 2, "f1", 9, 9), ("a", 3, "f2", 0, 1), ("a", 4, "f2", 0, 0), ("b", 5, "f1", 0, 0)]
    schema = "k string, v int, file_path string, block_start long, row_pos long"
    old = spark.createDataFrame([("a", 0)], "k string, v int")
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        new = spark.createDataFrame(order, schema).repartition(3)
        out = upsert(old, new, ["k"])
        assert out.columns == ["k", "v"] and {r["k"]: r["v"] for r in out.collect()} == {"a": 3, "b": 5}
    ties = [("a", v) for v in range(6)]
    found = {upsert(old, spark.createDataFrame(t, "k string, v int").coalesce(1), ["k"]).collect()[0]["v"]
             for t in (ties, ties[::-1])}
    assert len(found) == 1


def test_table_side_is_streamed(spark, tmp_dir):
    """The table is neither sorted nor aggregated by an upsert."""
    spark.range(1000).selectExpr("cast(id as string) k", "id v").write.parquet(f"{tmp_dir}/old")
    old = spark.read.parquet(f"{tmp_dir}/old")
    spark.createDataFrame([("5", 50)], "k string, v long").write.parquet(f"{tmp_dir}/new")
    new = spark.read.parquet(f"{tmp_dir}/new")
    node = upsert(old, new, ["k"])._jdf.queryExecution().executedPlan()
    node = node.inputPlan() if node.nodeName() == "AdaptiveSparkPlan" else node

    def above_table(n, names):
        children = n.children()
        if children.size() == 0:
            return names if n.nodeName().startswith("Scan parquet") else None
        for i in range(children.size()):
            found = above_table(children.apply(i), [*names, n.nodeName()])
            if found is not None:
                return found

    names = above_table(node, [])
    assert "BroadcastHashJoin" in names
    assert not [n for n in names if "Sort" in n or "Aggregate" in n or "Exchange" in n]


def write_export(path, rows):
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("key,value\n")
        for k, v in rows:
            f.write(k + ',"' + v.replace('"', '\\"') + '"\n')


def graph(price):
    return json.dumps({"line_graph": [{"year_sold": "2019", "avg_price": price, "median_price": price,
                                       "mode_price": price, "sale_count": 1}], "heatmap_graph": [], "sale_count": 1})


def test_batch_load_in_file_order(spark, tmp_dir):
    kent, essex = "county#kent#all#all#all#all", "county#essex#all#all#all#all"
    write_export(f"{tmp_dir}/one/b.csv", [(kent, graph(2.0)), (kent, graph(3.0))])
    write_export(f"{tmp_dir}/one/a.csv", [(kent, graph(1.0)), (essex, graph(9.0)), (" ", graph(1.0)), ("x", "{oops")])
    table = f"{tmp_dir}/table"
    assert load_export(spark, f"{tmp_dir}/one", table) == {
        "version": 1, "buckets_written": 2, "rows_read": 6, "blank_key": 1, "malformed": 1, "missing_sk": 0, "loaded": 4}
    price = lambda: {r["location_value"]: r["line_graph"][0]["avg_price"] for r in read_current(spark, table).collect()}
    assert price() == {"kent": 3.0, "essex": 9.0}
    write_export(f"{tmp_dir}/two/c.csv", [(essex, graph(7.0))])
    assert load_export(spark, f"{tmp_dir}/two", table)["version"] == 2
    assert price() == {"kent": 3.0, "essex": 7.0}
    # a load that failed left data, and a manifest without all its files
    head = spark.read.parquet(f"{table}/manifest/version=000002").where("path IS NULL")
    head.write.parquet(f"{table}/manifest/version=000003")
    spark.range(3).write.parquet(f"{table}/data/version=000003/bucket=0")
    assert price() == {"kent": 3.0, "essex": 7.0}
    write_export(f"{tmp_dir}/three/d.csv", [(kent, graph(4.0))])
    assert load_export(spark, f"{tmp_dir}/three", table)["version"] == 3
    assert price() == {"kent": 4.0, "essex": 7.0}


def test_round_by_value(spark):
    import random

    from pyspark.sql import functions as F

    from segmetrics.functions.json import _r

    rnd = random.Random(3)
    values = [-1138.025, 0.125, 2.675, 1.005, -0.375, 0.0, 33.335] + [rnd.randint(-10**7, 10**7) / 1000 for _ in range(400)] + [
        rnd.uniform(-1e6, 1e6) for _ in range(100)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", _r(F.col("v")).alias("two"), _r(F.col("v"), 1).alias("one")).collect():
        assert (r["two"], r["one"]) == (round(r["v"], 2), round(r["v"], 1)), r["v"]


def test_export_csv_roundtrip(spark, tmp_dir):
    kv = spark.createDataFrame([("county#k,1#all#all#all#all", GOOD)], "key string, value string")
    perf = parse_performance_kv(kv)
    out = performance_to_json(perf)
    write_key_value_csv(out, f"{tmp_dir}/perf")
    back = read_key_value_csv(spark, f"{tmp_dir}/perf").collect()
    assert len(back) == 1 and back[0]["key"] == "county#k,1#all#all#all#all"   # comma in key survives
    assert json.loads(back[0]["value"]) == {"line_graph": [{"year_sold": "2019", "avg_price": 1.5,
                                                             "median_price": 1.5, "mode_price": 1.5,
                                                             "sale_count": 2}],
                                            "heatmap_graph": [], "sale_count": 2}
    merged = upsert_performance(perf, parse_performance_kv(spark.createDataFrame(back)))
    assert merged.count() == 1


def test_export_rounding(spark):
    kv = spark.createDataFrame([("county#k#all#all#all#all", json.dumps({
        "line_graph": [{"year_sold": "2019", "avg_price": 0.125, "median_price": None, "mode_price": 2.5,
                        "sale_count": 1}],
        "heatmap_graph": [{"year_bought": "2018", "year_sold": "2019", "avg_appreciation_pounds": None,
                           "median_appreciation_pounds": 1.0, "sale_count": 1, "avg_appreciation_pct": None,
                           "median_appreciation_pct": 3.14159, "pct_sales_appreciated": 66.66666,
                           "biggest_loser_pounds": 1.0, "biggest_loser_pct": None,
                           "biggest_winner_pounds": 1.0, "biggest_winner_pct": None}]}))],
        "key string, value string")
    v = json.loads(performance_to_json(parse_performance_kv(kv)).collect()[0]["value"])
    p = v["line_graph"][0]
    assert (p["avg_price"], p["median_price"]) == (0.12, 0.0)      # half-even, null -> 0.0
    c = v["heatmap_graph"][0]
    assert c["avg_appreciation_pounds"] == 0.0 and c["avg_appreciation_pct"] is None
    assert c["median_appreciation_pct"] == 3.14 and c["pct_sales_appreciated"] == 66.7
    assert v["sale_count"] == 0


def test_dimension_json(spark):
    idx = spark.createDataFrame([("county", "kent", "Kent", 3)], "dimension_name string, value string, label string, sale_count bigint")
    r = dimension_to_json(idx).collect()[0]
    assert r["key"] == "meta#county" and json.loads(r["value"]) == {"sk": "kent", "label": "Kent", "sale_count": 3}


def test_observed_load_single_pass(spark, tmp_dir):
    from segmetrics.operators.upsert import observed_load

    kv = spark.createDataFrame([
        ("county#kent#all#all#all#all", GOOD), ("", GOOD), ("county#x#all#all#all#all", "nope"),
    ], "key string, value string")
    rows, obs = observed_load(kv)
    rows.write.mode("overwrite").parquet(f"{tmp_dir}/loaded")
    assert obs.get == {"rows_read": 3, "blank_key": 1, "malformed": 1, "missing_sk": 0, "loaded": 1}
    assert spark.read.parquet(f"{tmp_dir}/loaded").count() == 1
