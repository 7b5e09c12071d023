"""Bucketed tables: what a load reads and writes, and what it keeps."""
import os
import random

from pyspark.sql import functions as F

from segmetrics.config import stored
from segmetrics.plans.load import apply_load, read_current
from segmetrics.sources.buckets import BUCKET, bucket_of, version, versions, write_version

SCHEMA = "a string, b string, n long"
KEYS = ["a", "b"]


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, table):
    return sorted((r.a, r.b, r.n) for r in read_current(spark, table).collect())


def test_load_touches_its_buckets_only(spark, tmp_dir):
    rows = [(f"a{i % 50}", f"b{i}", i) for i in range(2000)]
    path = f"{tmp_dir}/t"
    first = write_version(table_of(spark, rows), path, KEYS, 16)
    assert len({f[0] for f in first.files}) == 16 and sum(f[2] for f in first.files) == 2000
    of = {(r.a, r.b): r.k for r in table_of(spark, rows).withColumn("k", bucket_of(KEYS, 16)).collect()}
    mine = [r for r in rows if of[r[0], r[1]] in (3, 7)][:20]
    load = [(a, b, -n) for a, b, n in mine] + [("new", f"b{i}", i) for i in range(3)]
    load_buckets = {of[a, b] for a, b, _ in mine} | {
        r[0] for r in table_of(spark, load[-3:]).select(bucket_of(KEYS, 16)).collect()}
    second, touched = apply_load(table_of(spark, load), path, KEYS)
    assert set(touched) == load_buckets and second.number == 2
    # files: new ones for the touched buckets, the old ones for the others
    assert {f for f in second.files if f[0] not in load_buckets} == {f for f in first.files if f[0] not in load_buckets}
    assert all("version=000002" in f[1] for f in second.files if f[0] in load_buckets)
    assert {int(d.split("=")[1]) for d in os.listdir(f"{path}/data/version=000002") if d.startswith("bucket=")} == load_buckets
    # what the load read: the files of its buckets
    read = {f.split("/data/")[1] for f in first.read(spark, touched).inputFiles()}
    assert read == {f[1].split("data/")[1] for f in first.files if f[0] in load_buckets}
    want = {(a, b): n for a, b, n in rows} | {(a, b): n for a, b, n in load}
    assert content(spark, path) == sorted((a, b, n) for (a, b), n in want.items())
    # the version before is still there
    assert sorted((r.a, r.b, r.n) for r in version(spark, path, 1).read(spark).collect()) == sorted(rows)


def test_small_load_does_not_exchange_the_table(spark, tmp_dir):
    from segmetrics.operators.upsert import upsert

    path = f"{tmp_dir}/t"
    first = write_version(table_of(spark, [(f"a{i}", "b", i) for i in range(1000)]), path, KEYS, 4)
    load = stored(table_of(spark, [("a1", "b", 9)]), "load")
    plan = upsert(first.read(spark).drop(BUCKET), load, KEYS)._jdf.queryExecution().executedPlan().toString()
    # the exchanges are those of the load's own keys, once for each use
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" not in plan


def test_many_loads(spark, tmp_dir):
    """Random loads, empty ones and null keys among them."""
    rng, path, want = random.Random(5), f"{tmp_dir}/t", {}
    for size in (30, 5, 0, 50, 1):
        load = {(rng.choice(["x", "y", None]), f"b{rng.randrange(40)}"): rng.randrange(100) for _ in range(size)}
        apply_load(table_of(spark, [(a, b, n) for (a, b), n in load.items()]), path, KEYS, 8)
        want.update(load)
        key = lambda r: str(r)
        assert sorted(((r.a, r.b, r.n) for r in read_current(spark, path).collect()), key=key) == sorted(
            ((a, b, n) for (a, b), n in want.items()), key=key)
    assert versions(spark, path) == [1, 2, 3, 4, 5]


def test_empty_table(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    assert version(spark, path) is None and versions(spark, path) == []
    write_version(table_of(spark, []), path, KEYS, 4)
    assert version(spark, path).read(spark).count() == 0
    assert read_current(spark, path).columns == ["a", "b", "n"]


def test_rows_of_a_file_are_sorted_by_key(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    rows = [(f"a{random.Random(i).randrange(10**6)}", "b", i) for i in range(3000)]
    write_version(table_of(spark, rows).repartition(7), path, KEYS, 2)
    read = version(spark, path).read(spark).select("a", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    for f in {r.f for r in read.collect()}:
        here = [r.a for r in sorted(read.where(F.col("f") == f).collect(), key=lambda r: r.i)]
        assert here == sorted(here)
