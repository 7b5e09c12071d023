"""Importance resampling towards a target distribution.

Features are runs of consecutive words, hashed into ``buckets``. Counts of
the buckets over all documents and over the target's texts give each bucket
a gain, the floored logarithm (in thousandths) of the smoothed ratio of its
two shares. A document's weight is the floored mean gain of its features;
with Gumbel noise, a function of its id, the highest scores are a sample
drawn by weight without replacement.

* Weights come from the array of gains (as many numbers as buckets, the same
  at every size), in one pass without a shuffle.
* The cutoff is the score of the last document drawn. Quantile sketches of
  the scores bracket it; exact counts above and inside the bracket validate
  it or widen it; only the bracket's scores are sorted.
* The documents at the cutoff or above are ranked by a sort by ranges.

Defined results: a null text has no words; a document without features has
weight 0; a null doc_id counts as an empty id in the noise and is larger than
all others; equal rows are documents of their own, of which the first ranks
are drawn; without target texts all counts of the target are 0; an empty
table gives an empty result.
"""
from __future__ import annotations

import hashlib
import math
from collections import Counter
from typing import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmetrics.llm.common import free_name, in_arrow, running_total, stored

LAST = (1 << 63) - 1  # the order of a null doc_id
SKETCH = 10_000  # accuracy of the quantile sketches
MARGIN = 0.002  # first bracket, as shares of the documents to each side
MEMO = 200_000  # words whose gain a task remembers
# letters A-Z are lowered; digits, letters and all bytes beyond ASCII are words
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()


def features(words: list[bytes], longest: int) -> list[bytes]:
    """Runs of 1 to ``longest`` consecutive words."""
    out = words
    for n in range(2, longest + 1):
        out = out + [b" ".join(words[i:i + n]) for i in range(len(words) - n + 1)]
    return out


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """How many features of the column ``text`` fall into each bucket. A task
    sends one count a bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(buckets, np.int64), Counter()

        def empty() -> None:
            for feature, n in held.items():
                counts[crc32(feature) % buckets] += n
            held.clear()

        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(features(words_of(text), longest))
                if len(held) > MEMO:
                    empty()
        empty()
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["bucket", "n"])

    rows = in_arrow(texts.select("text"), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:  # one a bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(counts: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket the floored log ratio in thousandths, in doubles."""
    b, total, goal = counts.size, float(counts.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * (total + b) / (float(s + 1) * (goal + b))))
                     for s, t in zip(counts.tolist(), target.tolist())], np.int64)


class _Gains(dict):
    """Gain by feature, remembered for ``MEMO`` short features."""

    def __init__(self, table: np.ndarray):
        super().__init__()
        self.table = table.tolist()

    def __missing__(self, feature: bytes) -> int:
        gain = self.table[crc32(feature) % len(self.table)]
        if len(self) < MEMO and len(feature) <= 64:
            self[feature] = gain
        return gain


def noise(doc_id: int | None, seed: str) -> int:
    """Floored Gumbel noise in thousandths, from the id's checksum."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, table: np.ndarray, longest: int = 1, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, text_hash, n_words, n_features, weight
    and score."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = _Gains(table)
        for batch in batches:
            ids, n_words, n_features, weights, scores = batch.column("doc_id").to_pylist(), [], [], [], []
            for doc_id, text in zip(ids, batch.column("text").to_pylist()):
                words = words_of(text)
                found = features(words, longest)
                weight = sum(map(gain.__getitem__, found)) // len(found) if found else 0
                n_words.append(len(words))
                n_features.append(len(found))
                weights.append(weight)
                scores.append(weight + noise(doc_id, seed))
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"),
                                   *(pa.array(x, pa.int64()) for x in (n_words, n_features, weights, scores))],
                                  names=["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(docs["text"]).alias("text_hash"), docs["text"].alias("text"))
    return in_arrow(rows, run, "doc_id long, text_hash long, n_words long, n_features long, weight long, score long")


def cutoff(scores: DataFrame, n: int, draw: int) -> int:
    """The ``draw``-th highest of the ``n`` scores (1 <= draw <= n)."""
    margin = MARGIN
    while True:
        at = 1 - draw / n
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = scores.agg(F.percentile_approx("score", ends, SKETCH)).first()[0]
        if ends[0] == 0.0 and ends[1] == 1.0:
            low, high = scores.agg(F.min("score"), F.max("score")).first()
        s = F.col("score")
        above, inside = scores.agg(F.count_if(s > high), F.count_if(s.between(low, high))).first()
        if above < draw <= above + inside:
            break
        margin *= 4
    bracket = scores.where(s.between(low, high)).groupBy((-s).alias("order")).agg(F.count(F.lit(1)).alias("n"))
    passed = running_total(bracket, ["order"], F.col("n"), "before", "resample-bracket").where(F.col("before") < draw - above)
    return -passed.agg(F.max("order")).first()[0]


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1, min_words: int = 20,
             percent: int = 10, seed: str = "2024") -> DataFrame:
    """Documents (doc_id, text) and target texts (text) -> one row per
    document: doc_id, text_hash, n_words, n_features, weight, score and rank,
    from 1 on, of the ``percent`` of the documents with ``min_words`` words
    that are drawn; null for the others."""
    table = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))
    rows = stored(scored(docs, table, longest, seed), "resample-scores")
    fit = F.col("n_words") >= min_words
    n = rows.where(fit).count()
    draw = n * percent // 100
    if not draw:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    drawable = fit & (F.col("score") >= cutoff(rows.where(fit).select("score"), n, draw))
    order = ["down", "ord", "n_features", "text_hash", "weight"]
    best = rows.where(drawable).withColumn("down", -F.col("score")).withColumn("ord", F.coalesce("doc_id", F.lit(LAST)))
    place = F.col("before") + 1
    ranked = running_total(best, order, F.lit(1), "before", "resample-ranks").select(
        *rows.columns, F.when(place <= draw, place).alias("rank"))
    return ranked.unionByName(rows.where(~drawable).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **how) -> DataFrame:
    """The drawn documents with all their columns. Of equal rows as many stay
    as were drawn."""
    drawn = resample(docs, target, **how).where("rank IS NOT NULL").groupBy(
        F.col("doc_id").alias("t_id"), F.col("text_hash").alias("t_hash")).agg(F.count(F.lit(1)).alias("t_n"))
    key, row = free_name(docs.columns, "key_hash"), free_name(docs.columns, "row_no")
    keyed = docs.select(*[docs[c] for c in docs.columns], F.xxhash64(docs["text"]).alias(key))
    met = keyed.join(drawn, keyed["doc_id"].cast("long").eqNullSafe(drawn["t_id"]) & (keyed[key] == drawn["t_hash"]))
    number = F.row_number().over(Window.partitionBy(keyed["doc_id"], keyed[key]).orderBy(keyed[key]))
    return met.withColumn(row, number).where(F.col(row) <= drawn["t_n"]).select(*[keyed[c] for c in docs.columns])
