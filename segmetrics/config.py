"""Session helpers: a tuned local session for tests/bench, and the shared
folder for intermediate tables (read from ``spark.checkpoint.dir``)."""
from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings that matter at scale; all are plain Spark SQL configs.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "segmetrics",
                  checkpoint_dir: str | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if checkpoint_dir and not shared_dir(spark, required=False):
        spark.conf.set("spark.checkpoint.dir", checkpoint_dir)
    return spark


def shared_dir(spark: SparkSession, required: bool = True) -> str | None:
    """The cluster's shared folder for intermediate data
    (``spark.checkpoint.dir``), or None if the session names none."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and required:
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    return d


def work_dir(spark: SparkSession) -> str:
    """``shared_dir``; a local session that names none, as in tests, gets a
    fresh folder of its own, any other session an error."""
    if not shared_dir(spark, required=False) and re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-work-"))
    return shared_dir(spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder for one written table."""
    return f"{work_dir(spark).rstrip('/')}/segmetrics/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back:
    later branches and lost executors re-read the files, not the plan. It
    has as many parts as the plan had partitions."""
    return _stored_at(df, scratch_path(df.sparkSession, name))


def _stored_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def stored_for_now(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``stored``, and its files are deleted at the end: for rows that nothing
    reads later."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    try:
        yield _stored_at(df, path)
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


# Shuffle files go when their query ends, not when the driver happens to
# collect its garbage; zstd takes about half the space of snappy for sales.
SPARING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


@contextmanager
def sparing_disk(spark: SparkSession) -> Iterator[None]:
    """While it lasts, the session's queries leave no shuffle files behind and
    write Parquet with zstd."""
    before = {k: spark.conf.get(k, None) for k in SPARING}
    try:
        for k, v in SPARING.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
