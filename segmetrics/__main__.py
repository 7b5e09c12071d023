"""Command line: build the serving tables, export them, or load exports.

    python -m segmetrics build  --input SALES_CSV_DIR --output OUT_DIR [--borough NAME]
                                [--require-address] [--export-csv]
    python -m segmetrics load   --source EXPORT_DIR --table TABLE_DIR [--kind performance|dimension]
    python -m segmetrics stream --source DROP_DIR --table TABLE_DIR --checkpoint CKPT_DIR
                                [--kind performance|dimension] [--available-now]

The session comes from the cluster defaults (master, memory, and
``spark.checkpoint.dir``, which must name a shared folder).
"""
from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from segmetrics.config import SCALE_CONF


def _build(args, spark: SparkSession) -> None:
    from segmetrics.functions.json import dimension_to_json, performance_to_json
    from segmetrics.operators.clean import borough_predicate, clean_sales
    from segmetrics.plans.build import build_serving_tables
    from segmetrics.plans.load import read_current
    from segmetrics.sources.csv import read_raw_sales, write_key_value_csv

    predicate = borough_predicate(args.borough) if args.borough else None
    sales = clean_sales(read_raw_sales(spark, args.input), predicate, args.require_address)
    paths = build_serving_tables(sales, args.output)
    if args.export_csv:
        write_key_value_csv(performance_to_json(read_current(spark, paths["performance"])),
                            f"{args.output}/performance_csv")
        write_key_value_csv(dimension_to_json(read_current(spark, paths["dimension_index"])),
                            f"{args.output}/dimension_index_csv")
    print(json.dumps(paths))


def _load(args, spark: SparkSession) -> None:
    from segmetrics.plans.load import load_export

    print(json.dumps(load_export(spark, args.source, args.table, args.kind)))


def _stream(args, spark: SparkSession) -> None:
    from segmetrics.streaming.loader import start_dimension_loader, start_performance_loader

    start = start_performance_loader if args.kind == "performance" else start_dimension_loader
    q = start(spark, args.source, args.table, args.checkpoint, available_now=args.available_now)
    q.awaitTermination()


def main(argv=None) -> None:
    parser = argparse.ArgumentParser(prog="segmetrics")
    sub = parser.add_subparsers(dest="cmd", required=True)
    b = sub.add_parser("build", help="raw sale CSV -> performance table + dimension index")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--borough", help="keep only sales of this district (case-insensitive)")
    b.add_argument("--require-address", action="store_true", help="drop sales without any address part")
    b.add_argument("--export-csv", action="store_true", help="also write (key, value) CSV exports")
    bl = sub.add_parser("load", help="apply a (key, value) export to a serving table")
    bl.add_argument("--source", required=True)
    bl.add_argument("--table", required=True)
    bl.add_argument("--kind", choices=["performance", "dimension"], default="performance")
    ld = sub.add_parser("stream", help="stream (key, value) drops into a serving change table")
    ld.add_argument("--source", required=True)
    ld.add_argument("--table", required=True)
    ld.add_argument("--checkpoint", required=True)
    ld.add_argument("--kind", choices=["performance", "dimension"], default="performance")
    ld.add_argument("--available-now", action="store_true", help="process what is there, then stop")
    args = parser.parse_args(argv)
    builder = SparkSession.builder.appName(f"segmetrics-{args.cmd}")
    for key, value in SCALE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        {"build": _build, "load": _load, "stream": _stream}[args.cmd](args, spark)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
