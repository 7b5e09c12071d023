"""Periodic runs: stretches of words that repeat with a period.

A run is a stretch with smallest period q (words q apart are equal) of at
least ``max(min_words, exponent * q)`` words that no neighbouring word
extends with that period. Runs are found in whole texts by recompression
(``recompression``):

* Harmonic grid. A run of period q holds a place and the place q after it at
  every ``max(min_words - q, (exponent - 1) * q)`` words, so for each q only
  that grid is asked: about n log n candidates for n words, and no more than
  n/2 log n for periods over 8.
* A candidate's two words are compared, then the grammar's extension queries
  give how far the two stretches agree to both sides, exactly.
* The same stretch found with multiples of its period keeps the smallest.

A task holds the grammar of ``CHUNK_BYTES`` of an Arrow batch's texts at a
time, or of one longer text; about 100 bytes a word. No shuffle.

Defined results: null and empty texts have no words, no runs and an empty
collapsed text; a text of fewer than ``min_words`` words has no runs; runs
may overlap; repeated rows get the same result each; an empty table gives an
empty result.
"""
from __future__ import annotations

from collections import defaultdict
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from segmetrics.llm.common import in_arrow
from segmetrics.llm.recompression import Grammar

CHUNK_BYTES = 1 << 20
CANDIDATES = 1 << 20  # asked at a time
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def _distinct(start: np.ndarray, length: np.ndarray, period: np.ndarray):
    """One of each (start, length): that of the smallest period."""
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(order.size, bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    return start[new], length[new], period[new]


def runs_of(sequences: list[np.ndarray], min_words: int, exponent: int) -> list[np.ndarray]:
    """(start, length, period) of every run of each sequence, by start and
    period. The sequences come longest first."""
    grammar = Grammar(sequences)
    sizes = np.array([len(s) for s in sequences], np.int64)
    owner = np.repeat(np.arange(sizes.size), sizes + 1)  # from place 1 on
    q = np.arange(1, int(sizes[0]) // exponent + 1)
    step = np.maximum(np.maximum(min_words - q, (exponent - 1) * q), 1)
    # only the first sequences are long enough for a period
    fit = np.searchsorted(-sizes, -np.maximum(min_words, exponent * q), side="right")
    end = np.concatenate(([0], np.cumsum(sizes + 1)))[fit]
    counts = np.maximum(0, -(-(end - q) // step)) + 1
    total = np.cumsum(counts)
    found = [np.empty((3, 0), np.int64)]
    at = 0
    while at < q.size:
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CANDIDATES, side="right")))
        n = counts[at:to]
        period = np.repeat(q[at:to], n)
        place = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(step[at:to], n)
        at = to
        inside = place + period < grammar.symbols.size
        place, period = place[inside], period[inside]
        alike = grammar.symbols[place] == grammar.symbols[place + period]
        place, period = place[alike], period[alike]
        alike = owner[place - 1] == owner[place + period - 1]
        place, period = place[alike], period[alike]
        before = grammar.backward(place - 1, place + period - 1)
        length = before + grammar.forward(place, place + period) + period
        good = length >= np.maximum(min_words, exponent * period)
        found.append(np.array(_distinct((place - before)[good], length[good], period[good])))
    start, length, period = _distinct(*np.concatenate(found, axis=1))
    order = np.lexsort((period, start))
    start, length, period = start[order], length[order], period[order]
    at = np.searchsorted(start, np.append(grammar.starts, grammar.symbols.size))
    return [np.column_stack([start[a:b] - s, length[a:b], period[a:b]])
            for a, b, s in zip(at[:-1].tolist(), at[1:].tolist(), grammar.starts.tolist())]


def _collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
    np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
    stay = np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()
    return b" ".join(map(words.__getitem__, stay))


def _chunks(texts: list[bytes], min_words: int) -> Iterator[list[int]]:
    """Numbers of texts to take together, longest first."""
    order = sorted((i for i, t in enumerate(texts) if len(t) + 1 >= 2 * min_words), key=lambda i: -len(texts[i]))
    held, size = [], 0
    for i in order:
        if held and size + len(texts[i]) > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(i)
        size += len(texts[i])
    if held:
        yield held


def _batch(texts: list[bytes], min_words: int, exponent: int) -> tuple[list[np.ndarray], list[bytes]]:
    none = np.empty((0, 3), np.int64)
    runs, collapsed = [none] * len(texts), [b""] * len(texts)
    long = set()
    for chunk in _chunks(texts, min_words):
        number: dict = defaultdict()
        number.default_factory = number.__len__
        words = {i: texts[i].split() for i in chunk}
        chunk.sort(key=lambda i: -len(words[i]))
        taken = [i for i in chunk if len(words[i]) >= min_words]
        long.update(chunk)
        if taken:
            for i, r in zip(taken, runs_of([np.fromiter(map(number.__getitem__, words[i]), np.int32, len(words[i]))
                                            for i in taken], min_words, exponent)):
                runs[i] = r
        for i in chunk:
            collapsed[i] = _collapsed(words[i], runs[i]) if len(runs[i]) else b" ".join(words[i])
    for i, t in enumerate(texts):
        if i not in long:
            collapsed[i] = b" ".join(t.split())
    return runs, collapsed


def find_runs(docs: DataFrame, keep: list[str] | None = None, min_words: int = 24, exponent: int = 3) -> DataFrame:
    """Documents (text) -> the columns ``keep`` (default: doc_id) with
    ``n_words``, ``runs`` (start, length, period of every run, by start and
    period) and ``collapsed``, the words joined by one blank without what
    runs repeat. ``exponent`` is 2 at least."""
    if exponent < 2 or min_words < 1:
        raise ValueError("exponent must be 2 and min_words 1 at least")
    kept = ["doc_id"] if keep is None else keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # UTF-8 words are split at the six ASCII blanks alone
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(batch.num_columns - 1).to_pylist()]
            runs, collapsed = _batch(texts, min_words, exponent)
            ends = np.concatenate(([0], np.cumsum([len(r) for r in runs]))).astype(np.int32)
            flat = np.concatenate(runs) if runs else np.empty((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], names=["start", "length", "period"])
            yield pa.record_batch([
                *batch.columns[:-1], pa.array([len(t.split()) for t in texts], pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), items),
                pa.array([c.decode("utf-8", "replace") for c in collapsed], pa.string())],
                names=[*[f"k{i}" for i in range(len(kept))], "n_words", "runs", "collapsed"])

    rows = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(kept)], docs["text"].alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])
    out = in_arrow(rows, run, schema)
    return out.toDF(*kept, "n_words", "runs", "collapsed")
