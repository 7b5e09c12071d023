"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and bad. A
text is compressed under each, in blocks of ``BLOCK`` bytes so that the
dictionaries count along the whole text and not just at its start. The
dictionary that fits better saves more; the score starts from

    difference = (size_bad - size_good) / (size_bad + size_good)

and is calibrated by a logistic curve of the difference, the rate at which
the good dictionary compresses, and that rate squared. No label, language, source or id
enters a score.

Fitting reads a bounded, documented sample of the labelled rows:
``SAMPLE_DOCS`` texts a class at most, of at most ``SAMPLE_CHARS``
characters each, chosen by a hash of the id; one half builds the
dictionaries, the other calibrates. The bound cuts the larger class more, so
the calibration texts are weighted back to the shares of the two classes
among all labels to learn from: a score is a probability at these shares,
whatever the sample's size. The model is a fixed size (two
dictionaries and ten numbers) and goes to the tasks in the closure of the
scoring function. Every whole text is scored, in one pass without a shuffle.

Defined results: a null or empty text scores as difference 0 and rate 1;
repeated rows score alike; without labels of both classes all scores are the
share of good labels (0.5 without labels); an empty table gives an empty
result.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmetrics.llm.common import in_arrow

BLOCK = 4096
DICT_BYTES = 65536
SAMPLE_DOCS = 2000
SAMPLE_CHARS = 20_000
LEVEL = 1
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]  # constant, and one a feature
    mean: tuple[float, ...] = (0.0, 0.0, 0.0)
    scale: tuple[float, ...] = (1.0, 1.0, 1.0)


class Sizes:
    """Compressed sizes of texts under the two dictionaries."""

    def __init__(self, good: bytes, bad: bytes):
        import zstandard as zstd

        def compressor(data: bytes):
            d = zstd.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False,
                                       write_dict_id=False)

        self.good, self.bad = compressor(good), compressor(bad)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Difference, rate and squared rate (both ends of the rate are odd)."""
        data = (text or "").encode("utf-8", "surrogatepass")
        if not data:
            return 0.0, 1.0, 1.0
        good = bad = 0
        for at in range(0, len(data), BLOCK):
            block = data[at:at + BLOCK]
            good += len(self.good.compress(block))
            bad += len(self.bad.compress(block))
        rate = good / len(data)
        return (bad - good) / (bad + good), rate, rate * rate


def _logistic(x: np.ndarray, y: np.ndarray, share: float, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights of a logistic curve: Newton's steps, halved until the loss
    falls. Rows weigh so that class 1 has ``share`` of the whole weight,
    which is the number of rows."""
    a = np.column_stack([np.ones(len(x)), x])

    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.sum(weight * (np.logaddexp(0, z) - y * z)) + ridge / 2 * w @ w)

    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(a.shape[1])
        step = np.linalg.solve(h, a.T @ (weight * (p - y)) + ridge * w)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step = step / 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    import zstandard as zstd

    blocks = [t[at:at + BLOCK] for t in texts for at in range(0, len(t), BLOCK)]
    try:
        return zstd.train_dictionary(DICT_BYTES, blocks, k=256, d=8).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself
        return b"".join(blocks)[-DICT_BYTES:] or b"\0" * 8


def sample_labelled(docs: DataFrame, labels: DataFrame, use: Column, n: int = SAMPLE_DOCS) -> tuple[list[list[str]], list[int]]:
    """Texts labelled bad (0) and good (1), at most ``n`` each of rows where
    ``use`` holds, by a hash of the id; and the number of such labels. Ids are drawn first, about 2 ``n`` a
    class, so a few thousand ids go to the tasks and their texts come back;
    no text is shuffled."""
    marked = labels.where(use & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marked.groupBy("quality").count().collect()}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    out = []
    for quality in (0, 1):
        below = min(1 << 30, -(-2 * n * (1 << 30) // max(1, counts.get(quality, 0))))
        ids = marked.where((F.col("quality") == quality) & (place < below)).select(
            F.col("doc_id").alias("l_id")).distinct().limit(4 * n)
        short = docs.where(F.length("text").between(1, SAMPLE_CHARS)).select("doc_id", "text")
        rows = short.join(F.broadcast(ids), F.col("doc_id") == F.col("l_id"), "left_semi").orderBy(
            F.xxhash64("doc_id"), "doc_id", "text").limit(n)
        out.append([r["text"] for r in rows.collect()])
    return out, [counts.get(quality, 0) for quality in (0, 1)]


def fit(docs: DataFrame, labels: DataFrame, use: Column, n: int = SAMPLE_DOCS) -> Model:
    """Fit on labelled documents; ``use`` selects the labels to learn from."""
    sample, (n_bad, n_good) = sample_labelled(docs, labels, use, n)
    bad, good = ([t.encode("utf-8", "surrogatepass") for t in x] for x in sample)
    if not bad or not good:
        share = len(good) / (len(good) + len(bad)) if good or bad else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(b"\0" * 8, b"\0" * 8, (float(np.log(share / (1 - share))), 0.0, 0.0, 0.0))
    half = lambda x, k: x[k::2] or x
    d_good, d_bad = _dictionary(half(good, 0)), _dictionary(half(bad, 0))
    sizes = Sizes(d_good, d_bad)
    texts = [(t, 1) for t in half(good, 1)] + [(t, 0) for t in half(bad, 1)]
    x = np.array([sizes.features(t.decode("utf-8", "surrogatepass")) for t, _ in texts])
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, np.array([y for _, y in texts], float), n_good / (n_good + n_bad))
    return Model(d_good, d_bad, tuple(map(float, w)), tuple(map(float, mean)), tuple(map(float, scale)))


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` (default: doc_id) and the score, called ``name``,
    of every row."""
    kept = keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = Sizes(model.good, model.bad)
        for batch in batches:
            x = np.array([sizes.features(t) for t in batch.column(batch.num_columns - 1).to_pylist()]).reshape(-1, 3)
            z = model.weights[0] + ((x - model.mean) / model.scale) @ np.array(model.weights[1:])
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.record_batch([*batch.columns[:-1], pa.array(s)], names=[*kept, name])

    rows = docs.select(*[docs[c] for c in kept], docs["text"].alias(name))
    return in_arrow(rows, run, T.StructType([*rows.schema.fields[:-1], T.StructField(name, T.DoubleType())]))
