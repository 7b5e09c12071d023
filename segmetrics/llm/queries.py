"""Registered queries of this subpackage: each applies its operator, with
production parameters, to its whole table."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmetrics.llm import (embedding_dedup, language_id, licenses, line_dedup, mixing, packing, periodic_runs, quality_model,
                            quality_rules, resampling, simhash, suffix_dedup, url_filters)
from segmetrics.llm.common import WORD, let, table
from segmetrics.llm.sql import ORACLE_SQL  # noqa: F401 - read by the entry module

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def learned_from(doc_id: F.Column) -> F.Column:
    """Labels that may be learned from: crc32 of the id as text mod 5 not 0."""
    return F.crc32(doc_id.cast("string")) % 5 != 0


def list_entries(pages: DataFrame) -> DataFrame:
    """Dated block-list entries derived from the pages' own hosts, since the
    tables hold none: betting hosts by their names, other hosts and path
    prefixes by a checksum, each added, removed and in part added again."""
    hosts = pages.select(url_filters.host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    h = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    entry = lambda name, pattern, when, added: F.struct(
        F.lit(name).alias("list_name"), pattern.alias("pattern"), when.alias("day"), F.lit(added).alias("added"))
    host, prefix = F.col("host"), F.concat("host", F.lit("/de/"))
    betting = F.col("host").rlike("casino|bets|poker")
    return hosts.select(F.explode(F.concat(
        F.when(betting, F.array(entry("gambling", host, day(F.lit(0)), True))).otherwise(F.array()),
        F.when(h % 3 == 0, F.array(
            entry("spam", host, day(h % 97), True), entry("spam", host, day(h % 97 + 60), False),
            entry("spam", host, day(h % 97 + 150), True))).otherwise(F.array()),
        F.when(h % 5 == 0, F.array(entry("policy", prefix, day(h % 200), True),
                                   entry("policy", prefix, day(h % 200 + 45), False))).otherwise(F.array()),
    )).alias("e")).select("e.*")


def captures(pages: DataFrame) -> DataFrame:
    """Pages as captures; the day of the fetch runs through 2024 by page id."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id"), F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetch_day"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), report=True)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filters.filter_urls(captures(pages), list_entries(pages))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.sample_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target",
                        (F.col("copies") * F.col("size")).alias("taken"), "copies", "source")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels, learned_from(F.col("doc_id")))
    s = F.col("score")
    return quality_model.score(docs, model).select(
        "doc_id", F.coalesce(~learned_from(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
        F.when(s >= quality_model.THRESHOLD, 1).otherwise(0).alias("predicted"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    learn = F.col("doc_id").isNotNull() & ~held_out
    found = language_id.identify(docs, language_id.fit(docs, learn))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text, the words joined by blanks; in a tenth of the
    documents, by the id's checksum, words from one place on repeat."""
    h = F.crc32(docs["doc_id"].cast("string"))
    g = F.floor(h / 10)

    def planted(words: F.Column) -> F.Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return let(F.struct(words.alias("w"), a.cast("int").alias("a"), p.cast("int").alias("p")), lambda x: F.transform(
            x["w"], lambda word, i: F.when(i < x["a"], word).otherwise(F.get(x["w"], x["a"] + (i - x["a"]) % x["p"]))))

    words = F.regexp_extract_all(docs["text"], F.lit(WORD), 0)
    return docs.select("doc_id", F.when((h % 10 == 0) & (F.regexp_count(docs["text"], F.lit(WORD)) > 0),
                                        F.array_join(let(words, planted), " ")).otherwise(docs["text"]).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    # runs come by start and period: of equal exponents the first stays
    best = F.aggregate("runs", F.lit(None).cast(periodic_runs.RUN), lambda best, r: F.when(
        best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


QUERIES = {f.__name__: f for f in (
    op1_line_dedup, op2_suffix_dedup, op3_embedding_dedup, op4_url_filters, op5_packing, op6_quality_rules, op7_license_scans, op8_simhash, op9_mixing,
    op10_quality_classifier, op11_importance_resampling, op12_language_id, op13_periodic_runs)}
