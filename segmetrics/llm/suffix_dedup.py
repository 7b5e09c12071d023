"""Suffix-array deduplication: repeated 50-byte strings across documents.

A byte goes if it lies in a ``WINDOW``-byte string that also starts in a
document with a smaller doc_id. Suffixes are sorted to that depth by
deep-shallow sorting (``suffix_sort``); those equal to the depth form a
class, and all of a class but the least document's are repeats.

Sorting every suffix of a corpus would move fifty times its bytes. Three
steps keep that small without losing a suffix that could matter:

1. Whole-text copies. Of documents with one text the least stays; the
   others hold nothing of their own.
2. Anchors. Each window has a least ``GRAM``-byte gram by a hash (its
   minimizer). Equal windows have equal minimizers, so a window whose
   minimizer occurs in one document only is no repeat. About one place in 14
   is a minimizer; 4 bytes of each are shuffled to find those which several
   documents have.
3. Neighbouring windows with one minimizer travel as one string (50 bytes
   and one more for each further window), to the bucket of the minimizer.
   A bucket's suffixes are sorted by themselves: no class spans buckets.

Two kinds of minimizers would make their bucket large: one with more than
``HOT`` places, as in a passage that a third of the corpus shares, and one of
a periodic text, whose string has no end. Their windows travel on their own,
to buckets by a hash of the window; of the equal windows of one text one
travels, with the places of the others. And before anything travels, equal
strings of one part of a batch are combined: the least document's goes on,
for the others it is settled that they repeat.

A text is shuffled once; the three steps that read it share that exchange.
A task holds ``PART`` bytes of texts (or one longer text), of which ``SLICE``
windows at a time travel on their own; or one bucket, of which one in
``SHELVES`` parts is sorted at a time. There is a bucket for each
``BUCKET_BYTES`` of text, one at least a partition; the buckets of a
partition come one after another, sorted by Spark.

Defined results: a null text is empty; a null doc_id is larger than all
others; rows with one doc_id are no copies of each other; a text under 50
bytes loses nothing; repeated rows get the same result; an empty table gives
an empty result.
"""
from __future__ import annotations

import hashlib
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.common import in_arrow, stored
from segmetrics.llm.suffix_sort import deep_shallow, words_at

WINDOW = 50
GRAM = 24
HOT = 4096
SHELVES = 32  # a bucket's suffixes are sorted in so many parts
PART = 8 << 20  # bytes of text
SLICE = 1 << 17  # windows
BUCKET_BYTES = 32 << 20
LONGEST = WINDOW - GRAM + 1  # windows that one place of a gram can be the minimizer of
BLOCK = 1 << 16
LAST = (1 << 63) - 1  # the order of a null doc_id
MIX = np.uint64(0x9E3779B97F4A7C15)
HOT_MARK = np.uint32(1 << 31)


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on."""
    words = words_at(data)
    n = data.size - GRAM + 1
    h = words[:n] * MIX
    for at in range(8, GRAM, 8):
        h ^= h >> np.uint64(29)
        h += words[at:at + n]
        h *= MIX
    return h ^ (h >> np.uint64(32))


def _window_minima(h: np.ndarray, width: int) -> np.ndarray:
    m, have = h, 1
    while have < width:
        step = min(have, width - have)
        m = np.minimum(m[:m.size - step], m[step:])
        have += step
    return m


class Anchors:
    """Runs of windows with one minimizer, of many texts at once."""

    def __init__(self, texts: list[bytes]):
        sizes = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if sizes.size else np.empty(0, np.int64)
        values, places = [], []
        n = self.data.size - WINDOW + 1
        for at in range(0, max(0, n), BLOCK):
            with np.errstate(over="ignore"):
                h = _gram_hashes(self.data[at:min(at + BLOCK, n) + WINDOW - 1])
            m = _window_minima(h, WINDOW - GRAM + 1)
            change = np.flatnonzero(m[1:] != m[:-1]) + 1
            if not places or values[-1][-1] != m[0]:
                change = np.concatenate(([0], change))
            if change.size:
                values.append(m[change])
                places.append(change + at)
        value = np.concatenate(values) if values else np.empty(0, np.uint64)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        # cut at the texts' borders: runs end with a text's last window, and
        # each text of WINDOW bytes or more starts one
        long = sizes >= WINDOW
        first, end = self.starts[long], self.starts[long] + sizes[long] - WINDOW + 1
        which = np.flatnonzero(long)
        cut = np.union1d(place, first) if first.size else place[:0]
        own = np.searchsorted(place, cut, side="right") - 1
        text = np.searchsorted(first, cut, side="right") - 1
        inside = (text >= 0) & (cut < end[np.maximum(text, 0)]) if first.size else np.zeros(0, bool)
        cut, own, text = cut[inside], own[inside], text[inside]
        nxt = np.append(cut[1:], n)
        self.value, self.place, self.text = value[own], cut, which[text] if which.size else text
        self.count = np.minimum(nxt, end[text]) - cut  # windows in the run
        head = np.searchsorted(self.text, np.arange(sizes.size))
        self.number = np.arange(cut.size) - head[self.text] if cut.size else cut  # of the run in its text

    def mixed(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = self.value * MIX
            return x ^ (x >> np.uint64(31))


def _pack(**arrays: np.ndarray) -> bytes:
    """Arrays of known types as one compressed block."""
    import zstandard as zstd

    parts = [np.ascontiguousarray(a).tobytes() for a in arrays.values()]
    sizes = np.array([len(p) for p in parts], "<u8").tobytes()
    return zstd.ZstdCompressor(level=1).compress(sizes + b"".join(parts))


def _unpack(block: bytes, *types) -> list[np.ndarray]:
    import zstandard as zstd

    data = zstd.ZstdDecompressor().decompress(block)
    sizes = np.frombuffer(data, "<u8", len(types))
    out, at = [], 8 * len(types)
    for size, kind in zip(sizes.tolist(), types):
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most PART bytes of text, or of one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column("text")
        size = np.diff(np.frombuffer(text.buffers()[1], np.int32, len(text) + 1 + text.offset)[text.offset:]).astype(np.int64)
        at = 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(np.cumsum(size[at:]), PART, side="right")))
            yield batch.slice(at, n)
            at += n


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _longs(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _emit_anchors(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, block): of each minimizer 4 bytes, its text and its
        number there, and whether its string is of a periodic text."""
        for batch in _parts(batches):
            a = Anchors(_texts(batch))
            if not a.place.size:
                continue
            ids, hashes, mixed = _longs(batch, "ord"), _longs(batch, "text_hash"), a.mixed()
            bucket = (mixed % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            keys, blocks = [], []
            for b in np.flatnonzero(np.diff(ends)).tolist():
                at = order[ends[b]:ends[b + 1]]
                text = a.text[at]
                new = np.flatnonzero(np.diff(text, prepend=-1))
                counts = np.diff(np.append(new, text.size))
                # the runs' numbers grow within a text: small differences
                keys.append(b)
                blocks.append(_pack(ids=_delta(ids[text[new]]), hashes=hashes[text[new]], counts=counts.astype("<u4"),
                                    numbers=_delta(a.number[at].astype("<u4")), prints=(mixed[at] >> np.uint64(32)).astype("<u4"), endless=a.count[at] > LONGEST))
            yield pa.record_batch([pa.array(keys, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[tuple[int, list]]:
    """Rows in runs of one ``key`` -> (key, its values)."""
    last, held = None, []
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(value).to_pylist()):
            if k != last and held:
                yield last, held
                held = []
            last = k
            held.append(v)
    if held:
        yield last, held


def _shared_anchors(hot_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ord, text_hash, marks): the numbers of a text's runs whose minimizer
        another document has too, the hot ones with the highest bit set."""
        for _, blocks in _groups(batches, "bucket", "block"):
            ids, hashes, text, numbers, prints, endless, n = [], [], [], [], [], [], 0
            for block in blocks:
                i, h, c, m, p, e = _unpack(block, "<i8", "<i8", "<u4", "<u4", "<u4", "?")
                ids.append(np.cumsum(i))
                hashes.append(h)
                text.append(np.repeat(np.arange(n, n + i.size), c))
                numbers.append(np.cumsum(m, dtype="<u4"))
                prints.append(p)
                endless.append(e)
                n += i.size
            ids, hashes, text, numbers, prints, endless = (np.concatenate(x) for x in (ids, hashes, text, numbers, prints, endless))
            order = np.lexsort((ids[text], prints))
            p, d = prints[order], ids[text][order]
            starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            new_doc = np.concatenate(([True], (p[1:] != p[:-1]) | (d[1:] != d[:-1])))
            docs, size = np.add.reduceat(new_doc.astype(np.int64), starts), np.diff(np.append(starts, p.size))
            apart = (size > hot_docs) | np.logical_or.reduceat(endless[order], starts)
            shared, hot = np.zeros(p.size, bool), np.zeros(p.size, bool)
            shared[order], hot[order] = np.repeat(docs > 1, size), np.repeat(apart, size)
            at = np.flatnonzero(shared)
            if not at.size:
                continue
            marks = numbers[at] | np.where(hot[at], HOT_MARK, np.uint32(0))
            t = text[at]
            at = np.argsort(t, kind="stable")
            marks, t = marks[at].astype("<u4"), t[at]
            new = np.flatnonzero(np.diff(t, prepend=-1))
            ends = np.append(new, t.size).astype(np.int32) * 4
            blob = pa.Array.from_buffers(pa.binary(), new.size, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(marks.tobytes())])
            yield pa.record_batch([pa.array(ids[t[new]]), pa.array(hashes[t[new]]), blob], names=["ord", "text_hash", "marks"])

    return run


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then start[1], ..."""
    total = np.cumsum(size)
    return np.arange(int(total[-1]) if size.size else 0) + np.repeat(start - np.concatenate(([0], total[:-1])), size)


def _marked_runs(batch: pa.RecordBatch) -> tuple[Anchors, np.ndarray, np.ndarray]:
    """The batch's anchors, which of its runs are marked, and which of these
    are hot."""
    a = Anchors(_texts(batch))
    head = np.searchsorted(a.text, np.arange(batch.num_rows))
    found, is_hot = [np.empty(0, np.int64)], [np.empty(0, bool)]
    for i, blobs in enumerate(batch.column("marks").to_pylist()):
        m = np.sort(np.frombuffer(b"".join(blobs), "<u4"))
        found.append((m & ~HOT_MARK).astype(np.int64) + head[i])
        is_hot.append(m >= HOT_MARK)
    return a, np.concatenate(found), np.concatenate(is_hot)


def _window_hashes(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A hash of the WINDOW bytes at each place."""
    eight = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.zeros(places.size, np.uint64)
    with np.errstate(over="ignore"):
        for at in (*range(0, WINDOW - 7, 8), WINDOW - 8):
            h = (h ^ eight[places + at].view("<u8").ravel()) * MIX
            h ^= h >> np.uint64(31)
    return h


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """True where the ``sizes`` bytes at a and b are the same."""
    out = np.zeros(a.size, bool)
    ends = np.cumsum(sizes)
    at = 0
    while at < a.size:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 50 * SLICE, side="right")))
        if to == at + 1:  # perhaps a very long one
            out[at] = np.array_equal(data[a[at]:a[at] + sizes[at]], data[b[at]:b[at] + sizes[at]])
        else:
            size = sizes[at:to]
            same = data[_ranges(a[at:to], size)] == data[_ranges(b[at:to], size)]
            out[at:to] = np.logical_and.reduceat(same, np.concatenate(([0], np.cumsum(size)[:-1])))
        at = to
    return out


def _combined(data, place, count, owner, hashes) -> np.ndarray:
    """For each run the one whose string it has too, of the least owner (and
    the first of this); its own number if it is that one or has no equal."""
    order = np.lexsort((place, owner, hashes, count))
    same = np.zeros(order.size, bool)
    same[1:] = (hashes[order][1:] == hashes[order][:-1]) & (count[order][1:] == count[order][:-1])
    least = order[np.maximum.accumulate(np.where(same, 0, np.arange(order.size)))]
    run, ref = order[same], least[same]
    true = _equal(data, place[run], place[ref], count[run] + WINDOW - 1)
    out = np.arange(order.size)
    out[run[true]] = ref[true]
    return out


class _Sender:
    """Rows (bucket, block, done) of the runs of one batch."""

    def __init__(self, batch: pa.RecordBatch, a: Anchors, buckets: int):
        self.a, self.buckets, self.ids, self.hashes = a, buckets, _longs(batch, "ord"), _longs(batch, "text_hash")

    def settled(self, place, count, text) -> pa.RecordBatch:
        """Windows that are known to repeat, neighbours as one stretch."""
        at = np.lexsort((place, text))
        p, c, t = place[at], count[at], text[at]
        new = np.flatnonzero(np.concatenate(([True], (p[1:] != p[:-1] + c[:-1]) | (t[1:] != t[:-1]))))
        first, n = p[new], np.add.reduceat(c, new)
        block = _pack(ids=self.ids[t[new]], hashes=self.hashes[t[new]], places=(first - self.a.starts[t[new]]).astype("<u4"),
                      counts=n.astype("<u4"))
        # any bucket will do
        return self._rows([int(self.ids[t[0]] % self.buckets)], [None], [block])

    def runs(self, key, place, count, text, more=None, extra=None) -> pa.RecordBatch:
        """Strings for the buckets of their keys. ``more``: how many further
        places of the text have a string; ``extra``: these, run by run."""
        a = self.a
        own = (key % np.uint64(self.buckets)).astype(np.int64)
        shelf = ((key // np.uint64(self.buckets)) % np.uint64(SHELVES)).astype(np.uint8)
        at = np.lexsort((shelf, own))
        ends = np.searchsorted(own[at], np.arange(self.buckets + 1))
        more = np.zeros(place.size, np.int64) if more is None else more
        head = np.cumsum(more) - more
        keys, blocks = [], []
        for b in np.flatnonzero(np.diff(ends)).tolist():
            r = at[ends[b]:ends[b + 1]]
            t = text[r]
            others = extra[_ranges(head[r], more[r])] - np.repeat(a.starts[t], more[r]) if extra is not None else place[:0]
            keys.append(b)
            blocks.append(_pack(ids=self.ids[t], hashes=self.hashes[t], places=(place[r] - a.starts[t]).astype("<u4"),
                                counts=count[r].astype("<u4"), shelves=shelf[r], more=more[r].astype("<u4"),
                                extra=others.astype("<u4"), data=a.data[_ranges(place[r], count[r] + WINDOW - 1)]))
        return self._rows(keys, blocks, [None] * len(keys))

    @staticmethod
    def _rows(keys, blocks, done) -> pa.RecordBatch:
        return pa.record_batch([pa.array(keys, pa.int32()), pa.array(blocks, pa.binary()), pa.array(done, pa.binary())],
                               names=["bucket", "block", "done"])


def _emit_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(bucket, block, done): the strings of marked runs and where they
        stand; done: runs that are settled as repeats."""
        for batch in _parts(batches):
            a, at, hot = _marked_runs(batch)
            if not at.size:
                continue
            send = _Sender(batch, a, buckets)
            place, count, text = a.place[at], a.count[at], a.text[at]
            with np.errstate(over="ignore"):
                ends = _window_hashes(a.data, place) * MIX + _window_hashes(a.data, place + count - 1)
            owner = send.ids[text]
            settled = owner > owner[_combined(a.data, place, count, owner, ends)]
            if settled.any():
                yield send.settled(place[settled], count[settled], text[settled])
            cold = np.flatnonzero(~settled & ~hot)
            if cold.size:
                yield send.runs(a.mixed()[at[cold]] >> np.uint64(7), place[cold], count[cold], text[cold])
            warm = ~settled & hot
            yield from _emit_windows(send, place[warm], count[warm], text[warm])

    return run


def _emit_windows(send: _Sender, place, count, text) -> Iterator[pa.RecordBatch]:
    """Runs cut into their windows, SLICE at a time: of equal ones the least
    document's first travels, with its further places in that text."""
    total = np.cumsum(count)
    for lo in range(0, int(total[-1]) if total.size else 0, SLICE):
        window = np.arange(lo, min(lo + SLICE, int(total[-1])))
        run = np.searchsorted(total, window, side="right")
        p, t = place[run] + (window - (total[run] - count[run])), text[run]
        one = np.ones(p.size, np.int64)
        key, owner = _window_hashes(send.a.data, p), send.ids[t]
        ref = _combined(send.a.data, p, one, owner, key)
        settled = owner > owner[ref]
        if settled.any():
            yield send.settled(p[settled], one[settled], t[settled])
        twin = ~settled & (ref != np.arange(p.size)) & (t == t[ref])
        more = np.bincount(ref[twin], minlength=p.size)
        extra = p[twin][np.argsort(ref[twin], kind="stable")]
        stay = np.flatnonzero(~settled & ~twin)
        if stay.size:
            yield send.runs(key[stay] >> np.uint64(7), p[stay], one[stay], t[stay], more[stay], extra)


def _repeats(ids, hashes, places, counts) -> pa.RecordBatch:
    """One row a text: its stretches as (place, windows) in 4 bytes each."""
    order = np.lexsort((places, hashes, ids))
    ids, hashes = ids[order], hashes[order]
    spots = np.column_stack([places[order], counts[order]]).astype("<u4")
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1]))))
    ends = (np.append(new, ids.size) * 8).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), new.size, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(spots.tobytes())])
    return pa.record_batch([pa.array(ids[new]), pa.array(hashes[new]), blob], names=["ord", "text_hash", "spots"])


def _sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, text_hash, spots): windows that a smaller document has too, as
    stretches. The rows of a bucket come together."""
    rows = (pa.record_batch([b.column("bucket"), pa.array(list(zip(b.column("block").to_pylist(), b.column("done").to_pylist())),
                                                         pa.list_(pa.binary()))], names=["bucket", "both"]) for b in batches)
    for _, both in _groups(rows, "bucket", "both"):
        for _, done in both:
            if done is not None:
                yield _repeats(*_unpack(done, "<i8", "<i8", "<u4", "<u4"))
        cols = [_unpack(b, "<i8", "<i8", "<u4", "<u4", "u1", "<u4", "<u4", "u1") for b, _ in both if b is not None]
        if not cols:
            continue
        ids, hashes, places, counts, shelves, more, extra, data = (np.concatenate(x) for x in zip(*cols))
        del cols
        counts, more = counts.astype(np.int64), more.astype(np.int64)
        starts, head = np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1), np.cumsum(more) - more
        for shelf in range(SHELVES):
            at = np.flatnonzero(shelves == shelf)
            if at.size:
                yield from _sorted_repeats(ids[at], hashes[at], places[at].astype(np.int64), counts[at], more[at],
                                           extra[_ranges(head[at], more[at])], data[_ranges(starts[at], counts[at] + WINDOW - 1)])


def _sorted_repeats(ids, hashes, places, counts, more, extra, data) -> Iterator[pa.RecordBatch]:
    """Sort the runs' suffixes; stretches of windows of which a smaller
    document has an equal one."""
    starts = np.cumsum(counts + WINDOW - 1) - (counts + WINDOW - 1)
    suffix, run = _ranges(starts, counts), np.repeat(np.arange(counts.size), counts)
    order, klass = deep_shallow(data, suffix, WINDOW)
    owner = ids[run[order]]
    least = np.minimum.reduceat(owner, np.flatnonzero(np.diff(klass, prepend=-1)))
    later = np.zeros(suffix.size, bool)
    later[order] = owner > least[klass]
    head = later.copy()
    head[1:] &= ~(later[:-1] & (run[1:] == run[:-1]))
    at = np.flatnonzero(head)
    if at.size:
        r = run[at]
        # what follows a stretch is no repeat, up to the next one
        yield _repeats(ids[r], hashes[r], places[r] + (suffix[at] - starts[r]), np.add.reduceat(later.astype(np.int64), at))
        # further places of a window: it is a run of its own
        r = r[more[r] > 0]
        if r.size:
            spot = extra[_ranges((np.cumsum(more) - more)[r], more[r])]
            yield _repeats(np.repeat(ids[r], more[r]), np.repeat(hashes[r], more[r]), spot, np.ones(spot.size, np.int64))


REPEATS = "ord long, text_hash long, spots binary"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their repeats -> what is removed and what stays."""
    for batch in _parts(batches):
        removed, spans, kept = [], [], []
        for text, repeats in zip(_texts(batch), batch.column("repeats").to_pylist()):
            spots = np.frombuffer(b"".join(repeats or ()), "<u4").astype(np.int64).reshape(-1, 2)
            gone = np.bincount(spots[:, 0], minlength=len(text) + 1)
            gone -= np.bincount(spots.sum(1) + WINDOW - 1, minlength=len(text) + 1)
            gone = np.cumsum(gone[:-1]) > 0
            removed.append(int(gone.sum()))
            spans.append(int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
        yield pa.record_batch([
            batch.column("ord"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
            names=["r_ord", "r_hash", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, with_kept: bool = False, hot_docs: int = HOT) -> DataFrame:
    """Documents (doc_id, text) -> one row per document: doc_id, n_bytes,
    n_removed, n_spans, kept_sha256 and, ``with_kept``, the remaining bytes."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["doc_id"], F.lit(LAST)).cast("long").alias("ord"),
                       F.xxhash64(text).alias("text_hash"), text.alias("text"))
    ids = stored(rows.select("doc_id", "ord", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"),
                             F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
                             F.when(F.octet_length("text") < WINDOW, F.col("text").cast("binary")).alias("short")), "suffix-ids")
    # stored: the join deals both sides anew, and Spark may split a common text
    first = stored(ids.groupBy(F.col("sha").alias("f_sha")).agg(F.min("ord").alias("first")), "suffix-first")
    placed = stored(ids.join(first, F.col("sha") == F.col("f_sha")).select(
        "doc_id", "ord", "text_hash", "n_bytes", "sha", "short", (F.col("ord") == F.col("first")).alias("own")), "suffix-placed")
    owners = placed.where("own").select(F.col("ord").alias("o_ord"), F.col("text_hash").alias("o_hash")).distinct()
    # one row per text; all that follows reads this one exchange
    texts = rows.select("ord", "text_hash", "text").join(
        owners, (F.col("ord") == F.col("o_ord")) & (F.col("text_hash") == F.col("o_hash")), "left_semi").dropDuplicates(
        ["ord", "text_hash"])
    n_bytes = ids.agg(F.sum("n_bytes")).first()[0] or 0
    buckets = parts * max(1, -(-n_bytes // (parts * BUCKET_BYTES)))

    def dealt(blocks: DataFrame) -> DataFrame:
        by_part = blocks.repartitionById(parts, F.col("bucket") % parts)
        return by_part if buckets == parts else by_part.sortWithinPartitions("bucket")

    anchors = in_arrow(texts, _emit_anchors(buckets), "bucket int, block binary")
    shared = in_arrow(dealt(anchors), _shared_anchors(hot_docs), "ord long, text_hash long, marks binary")
    marks = shared.groupBy(F.col("ord").alias("m_ord"), F.col("text_hash").alias("m_hash")).agg(
        F.collect_list("marks").alias("marks"))
    marked = texts.join(marks, (F.col("ord") == F.col("m_ord")) & (F.col("text_hash") == F.col("m_hash"))).select(
        "ord", "text_hash", "text", "marks")
    runs = in_arrow(marked, _emit_runs(buckets), "bucket int, block binary, done binary")
    repeats = in_arrow(dealt(runs), _sort_runs, REPEATS)
    by_text = repeats.groupBy(F.col("ord").alias("b_ord"), F.col("text_hash").alias("b_hash")).agg(
        F.collect_list("spots").alias("repeats"))
    cut = in_arrow(
        texts.join(by_text, (F.col("ord") == F.col("b_ord")) & (F.col("text_hash") == F.col("b_hash")), "left").select(
            "ord", "text_hash", "text", "repeats"),
        _remove, "r_ord long, r_hash long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    out = placed.join(cut, (F.col("ord") == F.col("r_ord")) & (F.col("text_hash") == F.col("r_hash")) & F.col("own"), "left")
    # of a later copy all goes, if it holds a window
    whole = F.col("n_bytes") >= WINDOW

    def value(own: str, all_gone, untouched) -> F.Column:
        return F.when(F.col("own"), F.col(own)).when(whole, all_gone).otherwise(untouched).alias(own)

    columns = [value("n_removed", F.col("n_bytes"), F.lit(0).cast("long")),
               value("n_spans", F.lit(1).cast("long"), F.lit(0).cast("long")),
               value("kept_sha256", F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha"))]
    if with_kept:
        columns.append(value("kept", F.lit(b""), F.col("short")))
    return out.select("doc_id", "n_bytes", *columns)
