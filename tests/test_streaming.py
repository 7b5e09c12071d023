"""Streaming loader: drops arrive as files; the current table is the last
write per key; replays are idempotent."""
import json
import os

from segmetrics.streaming.loader import (
    current_dimension_index,
    current_performance,
    load_reports,
    start_dimension_loader,
    start_performance_loader,
)


def drop(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "w") as f:
        f.write("key,value\n")
        for k, v in rows:
            f.write(k + ',"' + v.replace('"', '\\"') + '"\n')


def value(avg):
    return json.dumps({"line_graph": [{"year_sold": "2019", "avg_price": avg, "median_price": avg,
                                       "mode_price": avg, "sale_count": 1}], "heatmap_graph": [], "sale_count": 1})


def test_performance_stream(spark, tmp_dir):
    src, table, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    drop(src, "a.csv", [("county#kent#all#all#all#all", value(1.0)), ("county#essex#all#all#all#all", value(2.0)),
                        ("", value(9.0)), ("county#bad#all#all#all#all", "{oops")])
    q = start_performance_loader(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    drop(src, "b.csv", [("county#kent#all#all#all#all", value(3.0)), ("county#kent#all#all#all#all", value(4.0))])
    q = start_performance_loader(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    got = {r["location_value"]: r["line_graph"][0]["avg_price"] for r in current_performance(spark, table).collect()}
    assert got == {"kent": 4.0, "essex": 2.0}
    reports = {r["load_seq"]: r for r in load_reports(spark, table).collect()}
    assert (reports[0]["rows_read"], reports[0]["blank_key"], reports[0]["malformed"], reports[0]["loaded"]) == (4, 1, 1, 2)
    assert reports[1]["loaded"] == 2


def test_dimension_stream(spark, tmp_dir):
    src, table, ckpt = f"{tmp_dir}/src", f"{tmp_dir}/table", f"{tmp_dir}/ckpt"
    drop(src, "a.csv", [("meta#county", json.dumps({"sk": "kent", "label": "Kent"})),
                        ("meta#county", json.dumps({"sk": ""}))])
    q = start_dimension_loader(spark, src, table, ckpt, available_now=True)
    q.awaitTermination(120)
    rows = current_dimension_index(spark, table).collect()
    assert [(r["dimension_name"], r["value"], r["label"]) for r in rows] == [("county", "kent", "Kent")]
    (rep,) = load_reports(spark, table).collect()
    assert (rep["rows_read"], rep["missing_sk"], rep["loaded"]) == (2, 1, 1)
