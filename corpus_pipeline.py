"""The corpus pipeline: five of the operators in a row, each on what the
stage before it kept. A stage takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.llm import line_dedup, mixing, packing, quality_model, simhash
from segmetrics.llm.common import free_name, stored, table
from segmetrics.llm.queries import TOKENIZER, learned_from


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above."""
    model = quality_model.fit(docs, table(spark, sf_dir, "labels"), learned_from(F.col("doc_id")))
    name = free_name(docs.columns, "score")
    return quality_model.score(docs, model, docs.columns, name).where(
        F.col(name) >= quality_model.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without later copies of repeated line runs."""
    return line_dedup.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.deduplicate(docs, shingle=3, radius=3)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mixture takes them."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mixed documents in sequences."""
    return packing.pack_documents(docs, TOKENIZER)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_copies),
          ("mixing sources", mixture), ("packing", packed)]

# zstandard, XXH64 and the tokenizer have no DuckDB SQL; the tests hold the
# stages against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
