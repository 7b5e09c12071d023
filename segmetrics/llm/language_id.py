"""Language identification by averaged hashed subword embeddings.

A text is its letters, each in lower case, and blanks for all else. Its
subwords are the byte n-grams (``GRAMS``) that lie in a word, a blank on
either side included, hashed into ``BUCKETS``. Each bucket has an embedding; a
text is the mean of its subwords' embeddings, and a linear softmax over it
gives the languages' probabilities. Both are trained by stochastic gradient
descent in numpy. Neither a label, a source nor an id enters a prediction.
To predict, embeddings times weights are whole numbers of ``1 / SCALE``, so
that sums do not depend on how texts are batched.

Fitting reads a bounded, documented sample: ``SAMPLE_DOCS`` texts in all,
as many of each language, of at most ``SAMPLE_CHARS`` characters, chosen by a
hash of the id; languages beyond the ``LANGUAGES`` most frequent are not
learned. Each epoch takes a random stretch of every text, of random length,
so that short texts are learned too. A fifth of the sample is held back: it sets
the temperature at which the softmax is a probability, and the score under
which a prediction is rejected, the least one whose accepted predictions err
in ``MAX_ERROR`` at most (with one error more counted, for the sample's
size). The model is of fixed size; every whole text is scored in one pass
without a shuffle.

Defined results: a null text, and one without a letter, is ``und`` with
score 0, not accepted; repeated rows score alike; without labelled texts
every text is ``und``; with one language all texts are that language; an
empty table gives an empty result.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmetrics.llm.common import free_name, in_arrow

GRAMS = (2, 3, 4)
BITS = 15
BUCKETS = 1 << BITS
DIM = 16
SAMPLE_DOCS = 3000
SAMPLE_CHARS = 8000
LANGUAGES = 200
EPOCHS = 8
STEPS = 500  # at least, with more epochs for a small sample
BATCH = 32
RATE = 60.0
MAX_ERROR = 0.01
NONE = "und"
BLOCK = 1 << 19  # bytes hashed at a time
SCALE = 1 << 16


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logits: np.ndarray  # int32, in 1 / SCALE: a row for each bucket and one of zeros
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0


class _Lower(dict):
    """Characters by code: letters in lower case, blanks for all others."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        self[code] = out = char.lower() if char.isalpha() else " "
        return out


_LOWER = _Lower()


def letters(text: str | None) -> bytes:
    """The letters in lower case, blanks between words and at both ends."""
    return f" {text or ''} ".translate(_LOWER).encode("utf-8", "surrogatepass")


def subwords(data: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The bucket of the n-gram at each place, ``BUCKETS`` where none is;
    the places of each n in turn, by blocks: (first place, buckets)."""
    for at in range(0, data.size, BLOCK):
        part = data[at:at + BLOCK + max(GRAMS) - 1].astype(np.uint32)
        blank = part == 0x20
        for n in GRAMS:
            m = min(BLOCK, part.size - n + 1)
            if m <= 0:
                continue
            x = np.zeros(m, np.uint32)
            inside = np.zeros(m, bool)  # a blank within
            for k in range(n):
                x = x << np.uint32(8) | part[k:k + m]
                if 0 < k < n - 1:
                    inside |= blank[k:k + m]
            if n == 2:
                inside = blank[:m] & blank[1:1 + m]
            x = (x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            yield at, np.where(inside, BUCKETS, x >> np.uint32(32 - BITS))


def _features(text: str) -> np.ndarray:
    found = [x[x < BUCKETS] for _, x in subwords(np.frombuffer(letters(text), np.uint8))]
    return np.concatenate(found).astype(np.uint16) if found else np.empty(0, np.uint16)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(samples: list[np.ndarray], labels: np.ndarray, classes: int, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings by buckets times the softmax's weights, and its bias."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((DIM, classes)), np.zeros(classes)
    a_round = -(-len(samples) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // a_round))
    steps, step = epochs * a_round, 0
    for _ in range(epochs):
        order = rng.permutation(len(samples))
        for at in range(0, len(samples), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            parts = []
            for i in order[at:at + BATCH].tolist():
                x = samples[i]
                n = min(x.size, int(np.exp(rng.uniform(np.log(8), np.log(3000)))))
                places = np.arange(n) + int(rng.integers(0, x.size - n + 1))
                parts.append(x[places])
            sizes = np.array([p.size for p in parts])
            idx = np.concatenate(parts)
            mean = np.add.reduceat(emb[idx], np.concatenate(([0], np.cumsum(sizes)[:-1]))) / sizes[:, None]
            p = _softmax(mean @ out + bias)
            p[np.arange(sizes.size), labels[order[at:at + BATCH]]] -= 1
            p /= sizes.size
            back = (p @ out.T) / sizes[:, None]
            out -= rate / 10 * mean.T @ p
            bias -= rate / 100 * p.sum(0)
            touched, slot = np.unique(idx, return_inverse=True)
            owner = np.repeat(np.arange(sizes.size), sizes)
            for d in range(DIM):
                emb[touched, d] -= rate * np.bincount(slot, back[owner, d], touched.size)
    return emb @ out, bias


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the least log loss, every text's label smoothed by
    half a text in all so that a sample without errors has one too."""
    ts = np.exp(np.linspace(np.log(0.02), np.log(20), 120))
    soft = np.full(z.shape, 0.5 / max(1, len(y)) / max(1, z.shape[1] - 1))
    soft[np.arange(len(y)), y] = 1 - 0.5 / max(1, len(y))
    loss = [-(soft * np.log(np.maximum(_softmax(z / t), 1e-300))).sum() for t in ts]
    return float(ts[int(np.argmin(loss))])


def _threshold(score: np.ndarray, right: np.ndarray) -> float:
    """The least score whose predictions from it on err in MAX_ERROR at most,
    one error more counted; if none does, that of the least such rate."""
    order = np.argsort(-score, kind="stable")
    rate = (np.cumsum(~right[order]) + 1) / (np.arange(order.size) + 2)
    good = np.flatnonzero(rate <= MAX_ERROR)
    return float(score[order[good[-1] if good.size else int(np.argmin(rate))]])


def sample_texts(docs: DataFrame, use: Column, n: int = SAMPLE_DOCS) -> list[tuple[str, str]]:
    """(language, text) of a bounded sample of the rows where ``use`` holds;
    the same number of each language, the least hashes of the ids."""
    counts = {r["lang"]: r["count"] for r in docs.where(use & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(
        F.desc("count"), "lang").limit(LANGUAGES).collect()}
    if not counts:
        return []
    each = max(1, n // len(counts))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    below = F.create_map(*[F.lit(x) for lang, c in counts.items() for x in (lang, min(1 << 30, -(-3 * each * (1 << 30) // c)))])
    rows = docs.where(use & (place < F.try_element_at(below, F.col("lang"))) & F.length("text").between(1, SAMPLE_CHARS)
                      & F.col("text").rlike(r"\p{L}")).select("lang", "text", place.alias("place"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("place", "text"))
    return [(r["lang"], r["text"]) for r in rows.withColumn("n", number).where(F.col("n") <= each).orderBy("lang", "n").collect()]


def fit(docs: DataFrame, use: Column, n: int = SAMPLE_DOCS) -> Model | None:
    """Fit on labelled documents (text, lang); ``use`` selects the rows to
    learn from. None without labelled texts."""
    sample = sample_texts(docs, use, n)
    if not sample:
        return None
    languages = tuple(sorted({lang for lang, _ in sample}))
    y = np.array([languages.index(lang) for lang, _ in sample])
    x = [_features(text) for _, text in sample]
    back = np.arange(len(x)) % 5 == 4
    if not back.any():
        back[:] = True
    learn = np.flatnonzero(~back) if (~back).any() else np.arange(len(x))
    table, bias = train([x[i] for i in learn], y[learn], len(languages))
    table = np.vstack([np.rint(table * SCALE).astype(np.int32), np.zeros((1, len(languages)), np.int32)])
    z = np.array([table[x[i]].mean(0) / SCALE + bias for i in np.flatnonzero(back)])
    t = _temperature(z, y[back]) if len(languages) > 1 else 1.0
    p = _softmax(z / t)
    return Model(languages, table, bias, t, _threshold(p.max(1), p.argmax(1) == y[back]))


def probabilities(texts: list[str | None], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """The languages' probabilities of each text, and how many subwords it
    has (0: no letter)."""
    parts = [letters(t) for t in texts]
    sums, counts = np.zeros((len(parts), len(model.languages)), np.int64), np.zeros(len(parts), np.int64)
    at = 0
    while at < len(parts):
        to, size = at, 0
        while to < len(parts) and (to == at or size + len(parts[to]) <= BLOCK):
            size += len(parts[to])
            to += 1
        ends = np.cumsum([len(p) for p in parts[at:to]])
        data = np.frombuffer(b"".join(parts[at:to]), np.uint8)
        for first, found in subwords(data):
            here = np.flatnonzero(found < BUCKETS)
            if not here.size:
                continue
            # no n-gram spans two texts: two blanks meet there
            new = np.searchsorted(here, np.concatenate(([0], ends[:-1])) - first)
            text = np.flatnonzero(np.diff(np.append(new, here.size)))
            new = new[text]
            sums[at + text] += np.add.reduceat(model.logits.take(found[here], axis=0), new, dtype=np.int64)
            counts[at + text] += np.diff(np.append(new, here.size))
        at = to
    z = sums / (SCALE * np.maximum(counts, 1)[:, None]) + model.bias
    return _softmax(z / model.temperature), counts


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: doc_id) with lang_pred, score and
    accepted (columns of these names get underscores) of every row."""
    kept = ["doc_id"] if keep is None else keep
    names: list[str] = []
    for name in ("lang_pred", "score", "accepted"):
        names.append(free_name([*kept, *names], name))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = [NONE] * len(texts), np.zeros(len(texts))
            if model is not None and texts:
                p, n = probabilities(texts, model)
                score = np.where(n > 0, p.max(1), 0.0)
                lang = [model.languages[k] if m else NONE for k, m in zip(p.argmax(1).tolist(), n.tolist())]
            accepted = (score > 0) & (score >= (model.threshold if model else 1.0))
            yield pa.record_batch([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score), pa.array(accepted)],
                                  names=[*[f"k{i}" for i in range(len(kept))], "lang_pred", "score", "accepted"])

    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(kept)], docs["text"].alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())])
    return in_arrow(rows, run, schema).toDF(*kept, *names)
