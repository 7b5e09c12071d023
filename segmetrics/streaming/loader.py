"""Loading (key, value) CSV drops into the serving tables as a stream.

A file source watches a drop folder; each micro-batch is parsed with the
same rules as the batch loader (blank keys and malformed JSON rejected,
missing graphs -> []) and appended to a change table partitioned by batch
id. Every row carries ``load_seq`` (the batch id) and its place in the
files of the batch (path, block, row), so the current table is the last row
per key: a ``max_by`` aggregation at read time. Rejected rows are counted in the same pass that writes a batch
(``observe``) and kept as one report row per batch. A batch is written to its
own ``load_seq=<id>`` folder with overwrite,
so a replayed batch after a failure replaces itself (exactly-once with the
query checkpoint).
"""
from __future__ import annotations

import os
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from segmetrics.operators.upsert import latest, observed_load
from segmetrics.schema import KEY_COLUMNS, KEY_VALUE_SCHEMA
from segmetrics.sources.csv import LOAD_PLACE

SEQ = ["load_seq", *LOAD_PLACE]


def _drops(spark: SparkSession, source_dir: str, files_per_batch: int) -> DataFrame:
    return (
        spark.readStream.schema(KEY_VALUE_SCHEMA)
        .option("header", True)
        .option("escape", "\\")
        .option("maxFilesPerTrigger", files_per_batch)
        .csv(source_dir)
        .select("key", "value", F.col("_metadata.file_path").alias("file_path"),
                F.col("_metadata.file_block_start").alias("block_start"))
    )


def _start(
    spark: SparkSession,
    source_dir: str,
    table_dir: str,
    checkpoint_location: str,
    kind: str,
    files_per_batch: int,
    available_now: bool,
) -> StreamingQuery:
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows, obs = observed_load(batch.withColumn("row_pos", F.monotonically_increasing_id()), kind,
                                  batch_id, keep=LOAD_PLACE)
        rows.drop("load_seq").write.mode("overwrite").parquet(os.path.join(table_dir, f"load_seq={batch_id}"))
        # rows read / rejected, counted in the same pass as the write above
        report = {"load_seq": batch_id, **obs.get}
        batch.sparkSession.createDataFrame([report]).write.mode("overwrite").json(
            os.path.join(table_dir, "_load_reports", f"load_seq={batch_id}"))

    writer = (
        _drops(spark, source_dir, files_per_batch)
        .writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint_location)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def start_performance_loader(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_location: str,
                             files_per_batch: int = 1, available_now: bool = False) -> StreamingQuery:
    """Stream performance (key, value) drops into the change table."""
    return _start(spark, source_dir, table_dir, checkpoint_location, "performance", files_per_batch, available_now)


def start_dimension_loader(spark: SparkSession, source_dir: str, table_dir: str, checkpoint_location: str,
                           files_per_batch: int = 1, available_now: bool = False) -> StreamingQuery:
    """Stream dimension (key, value) drops into the change table."""
    return _start(spark, source_dir, table_dir, checkpoint_location, "dimension", files_per_batch, available_now)


def current_performance(spark: SparkSession, table_dir: str) -> DataFrame:
    """Current performance table: the last loaded row per segment key."""
    return latest(spark.read.parquet(table_dir), KEY_COLUMNS, SEQ)


def load_reports(spark: SparkSession, table_dir: str) -> DataFrame:
    """Per-batch load reports (rows read, blank keys, malformed, loaded)."""
    return spark.read.json(os.path.join(table_dir, "_load_reports"))


def current_dimension_index(spark: SparkSession, table_dir: str) -> DataFrame:
    """Current dimension index: the last loaded row per (dimension, value)."""
    return latest(spark.read.parquet(table_dir), ["dimension_name", "value"], SEQ)
