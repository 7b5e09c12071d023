"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits: bit b is set if over half of the shingle hashes
have it set. Two fingerprints link at ``radius`` (3) or fewer differing
bits, and linked ones form components.

Plain ball hashing for an odd radius 3 needs all variants within 2 bits on
one side, 2081 rows for each fingerprint. Here the bits are cut into three
parts, and each part is blanked in turn. Of three differing bits at least
one lies in some part, so with that part blanked at most two are left, and
both fingerprints emit a common variant within one bit, half of two. That
takes 132 rows for each distinct fingerprint and finds every link. Colliding
pairs are verified on all 64 bits.

A bucket of variants that grows over ``BUCKET`` members isn't paired: its
members take the plain form, all variants within 2 bits. There, everything
within 1 bit of a variant lies within 3 bits of everything within 2 bits of
it, so linking all to one of the inner members is exact, linear and needs no
pairs; a variant has at most 2081 distinct fingerprints around it.

Only distinct fingerprints enter; documents with the same one are linked by
it. Defined results: null and empty texts have fingerprint 0, linked like
any other; fewer words than a shingle make one shingle; repeated rows and
ids are rows of their own; a component of null ids only has a null id; an
empty table gives an empty result.
"""
from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmetrics.llm.common import content_hash, in_arrow, stored
from segmetrics.llm.components import components

BITS = 64
PARTS = ((0, 22), (22, 43), (43, 64))
BUCKET = 64
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text's word shingles (repeats count)."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-shingle] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:].tolist())], dtype=np.uint64)
    # counted in slices: a bit of each hash takes a byte
    ones = np.zeros(BITS, np.int64)
    for at in range(0, hashes.size, 4096):
        part = hashes[at:at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * ones > hashes.size).tolist())


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, text_hash, fp (64 bits as a
    signed long); one row per document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column("text").to_pylist()], dtype=np.uint64)
            yield pa.record_batch([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps.view(np.int64))],
                                  names=["doc_id", "text_hash", "fp"])

    rows = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return in_arrow(rows, run, "doc_id long, text_hash long, fp long")


def _bits(x: int) -> Column:
    """64 bits as a long literal (by its text: the gateway reads no -2**63)."""
    return F.lit(str(x - (1 << 64) if x >= 1 << 63 else x)).cast("long")


def _variants():
    """For each part: the mask of the bits that stay, and what to xor in: a
    mark of the part at its lowest bit, and none or one of the other bits."""
    for lo, hi in PARTS:
        blank = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        yield ((1 << 64) - 1) ^ blank, 1 << lo, [0, *(1 << b for b in range(BITS) if not lo <= b < hi)]


def _emitted(fps: DataFrame) -> DataFrame:
    def variants(keep: int, mark: int, flips: list[int]) -> Column:
        left = F.col("fp").bitwiseAND(_bits(keep))
        return F.transform(F.array(*[_bits(mark ^ flip) for flip in flips]), lambda x: left.bitwiseXOR(x))

    return fps.select(F.explode(F.concat(*[variants(*v) for v in _variants()])).alias("key"), "fp")


def _links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Verified links among rows sorted by key. A pair meets under several
    keys; it is taken where the key is a fixed one of its middle points."""
    found_a, found_b = [], []
    kept = [(np.uint64(keep), np.uint64(mark)) for keep, mark, _ in _variants()]
    for step in range(1, BUCKET):
        at = np.flatnonzero(keys[step:] == keys[:-step]) if step < keys.size else np.empty(0, np.int64)
        if not at.size:
            break
        a, b = np.minimum(fps[at], fps[at + step]), np.maximum(fps[at], fps[at + step])
        k = keys[at]
        near = (a != b) & (np.bitwise_count(a ^ b) <= radius)
        a, b, k = a[near], b[near], k[near]
        first = np.zeros(a.size, bool)
        for keep, mark in kept:
            off = (a ^ b) & keep
            lowest = off & (~off + np.uint64(1))
            middle = np.where(np.bitwise_count(off) == 2, a ^ lowest, a)
            first |= ((middle & keep) ^ mark) == k
        found_a.append(a[first])
        found_b.append(b[first])
    if not found_a:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _verify(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive sorted by key. At most BUCKET members of the last key
        are carried on to the next batch; a larger bucket is passed on, as
        rows without a partner."""
        def out(a, b):
            return pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)) if b is not None else
                                    pa.nulls(a.size, pa.int64())], names=["a", "b"])

        keys, fps, full = np.empty(0, np.uint64), np.empty(0, np.uint64), None
        for batch in batches:
            k = np.concatenate([keys, batch.column("key").to_numpy().view(np.uint64)])
            f = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            if full is not None:  # the last batch ended inside a large bucket
                same = k == full
                if same.any():
                    yield out(f[same], None)
                    k, f = k[~same], f[~same]
                if k.size:
                    full = None
            if not k.size:
                keys, fps = k, f
                continue
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
            sizes = np.diff(np.append(starts, k.size))
            large = sizes > BUCKET
            if large.any():
                rows = np.repeat(large, sizes)
                yield out(f[rows], None)
                full = k[-1] if large[-1] else None
                k, f = k[~rows], f[~rows]
            if full is None and k.size:
                tail = int((k[::-1] == k[-1]).argmin()) if (k != k[-1]).any() else k.size
            else:
                tail = 0
            keys, fps = k[k.size - tail:], f[f.size - tail:]
            a, b = _links(k[:k.size - tail], f[:f.size - tail], radius)
            if a.size:
                yield out(a, b)
        a, b = _links(keys, fps, radius)
        if a.size:
            yield out(a, b)

    return run


def _large_bucket_links(fps: DataFrame) -> DataFrame:
    """Links among the members of large buckets: every variant within 2 bits;
    all members link to the least one within 1 bit of the variant."""
    first = fps.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("i"))
    # no bit (-1), bit i alone (j = i), or bits i < j
    both = first.select("fp", "i", F.explode(F.when(F.col("i") < 0, F.array("i")).otherwise(
        F.sequence(F.col("i"), F.lit(BITS - 1)))).alias("j"))
    one = lambda c: f"shiftleft(1L, {c})"
    near = both.select(
        F.expr(f"fp ^ if(i < 0, 0L, {one('i')}) ^ if(j > i, {one('j')}, 0L)").alias("key"), "fp",
        F.expr("if(i = j, fp, null)").alias("hub"))
    met = near.groupBy("key").agg(F.min("hub").alias("b"), F.collect_set("fp").alias("members")).where(
        (F.size("members") > 1) & F.col("b").isNotNull())
    return met.select(F.explode("members").alias("a"), "b").where("a <> b").distinct()


def fingerprint_links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Distinct fingerprints (fp) -> links (a, b) that connect all pairs at
    ``radius`` or fewer bits; every row of the result is such a pair."""
    if radius != 3:
        raise ValueError("the parts and variants are laid out for radius 3")
    sorted_keys = _emitted(fps).repartition("key").sortWithinPartitions("key")
    met = stored(in_arrow(sorted_keys, _verify(radius), "a long, b long"), "simhash-met")
    large = met.where("b IS NULL").select(F.col("a").alias("fp")).distinct()
    return met.where("b IS NOT NULL").select("a", "b").union(_large_bucket_links(large))


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Documents (doc_id, text) -> one row per document: doc_id, text_hash,
    fp, component_id (least doc_id of the component) and keeper_hash (text
    hash of the document with that id which stays)."""
    prints = stored(fingerprints(docs, shingle), "simhash-prints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"))
    fps = stored(prints.groupBy("fp").agg(F.min(order).alias("first")), "simhash-distinct")
    linked = components(fingerprint_links(fps.select("fp"), radius))
    named = fps.join(linked, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group"))
    # stored: the join deals both sides anew, and Spark may split a large group
    least = stored(named.groupBy(F.col("group").alias("g")).agg(F.min("first").alias("least")), "simhash-least")
    groups = named.join(least, F.col("group") == F.col("g")).select(
        F.col("fp").alias("g_fp"), F.col("least.id").alias("component_id"), F.col("least.hash").alias("keeper_hash"))
    return prints.join(groups, F.col("fp") == F.col("g_fp")).select(
        "doc_id", "text_hash", "fp", "component_id", "keeper_hash")


def deduplicate(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents, all columns, with one document of each component; of
    rows with its id and text that of the least hash of all columns."""
    found = near_duplicates(docs, shingle, radius)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_hash") == F.col("keeper_hash"))
                       ).select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    text_hash = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    named = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["doc_id"].alias("k_doc"),
                        text_hash.alias("k_text"))
    kept = named.join(keep, F.col("k_doc").eqNullSafe(F.col("k_id")) & (F.col("k_text") == F.col("k_hash")), "left_semi")
    return kept.groupBy("k_doc", "k_text").agg(F.min_by("doc", content_hash(docs, "doc.")).alias("doc")).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
