"""Packing token sequences: vector bin packing with the dot-product rule.

An example has a demand in three dimensions: tokens, segments (1 a piece)
and loss-bearing tokens. A sequence holds limited amounts of each. While a
sequence is open, the example with the largest dot product of its demand
and the room left, both in shares of the limits, goes in next. Examples may
be cut, from their front on: one larger than a sequence demands what there
is room for, and when no example fits whole, the best cut of any is taken. A
sequence closes when no piece finds room. What is shorter than a sequence
then is split at powers of two, lengths that need no padding. At most 64
short sequences of a batch, its last ones, go back among the examples of the
task's next batch instead.

A document is an instruction, its first line, and an answer, the rest with
the end token: the loss-bearing tokens. A text without a line break is all
answer, but for its first token, which nothing precedes. Of the 4096 tokens
of a sequence at most 3840 bear loss, so sequences keep at least a sixteenth
for instructions, a limit that answers alone would pass.

Documents never meet across tasks: each task packs the documents of its
scan split, batch by batch, so there is no shuffle, a task's memory is one
Arrow batch and 64 sequences, and a lost executor repeats its splits
with the same result. Sequence ids carry the split's number in their upper
bits.

Token ids come through bounded caches of chunks and words. The tests hold the ids against the tokenizer's on
whole texts.

Defined results: a null or empty text is the end token alone; repeated rows
and null ids are documents of their own; an empty table gives an empty
result; a text of any length is cut into pieces; a text whose first line has
no token is all answer.
"""
from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from segmetrics.llm.common import in_arrow

END_ID = 2
MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 3840
REST = 64
CACHE = 1_000_000
# texts of ASCII and Latin letters, digits and marks, without apostrophes
# (which begin tokens of their own); these split into words by the pattern
PLAIN = re.compile("[ \\t\\n\\rA-Za-zÀ-ÖØ-öø-ÿ0-9!-&(-/:-@\\[-`{-~]*")
PIECE = re.compile("[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\\[-`{-~]+")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself
    where it prints, else the next letter after the 256th."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {**{b: chr(b) for b in prints}, **{b: chr(256 + i) for i, b in enumerate(others)}}


class CachedTokenizer:
    """Ids of a text as little-endian uint32 bytes, through two bounded
    caches: white-space separated chunks, and the words inside them. No token
    of the vocabulary spans white space. Words of plain texts go to the
    tokenizer's model, chunks of other texts through all of the tokenizer."""

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tokenizer, self.cache = Tokenizer.from_file(path), cache
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.chunks: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])
            if len(self.words) >= self.cache:
                self.words.clear()
            self.words[word] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        found = b"".join(map(self._word, PIECE.findall(chunk)))
        if len(self.chunks) >= self.cache // 2:
            self.chunks.clear()
        self.chunks[chunk] = found
        return found

    def _other(self, chunk: str) -> bytes:
        found = self.others.get(chunk)
        if found is None:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
            found = b"".join([i.to_bytes(4, "little") for i in ids])
            if len(self.others) >= self.cache // 4:
                self.others.clear()
            self.others[chunk] = found
        return found

    def examples(self, texts: list[str | None]) -> Iterator[tuple[bytes, int]]:
        """Of each text the ids with the end token, and how many of them bear
        no loss: those of its first line, or one if it is the only line."""
        end = END_ID.to_bytes(4, "little")
        for text in texts:
            text = text or ""
            first, more, _ = text.partition("\n")
            # a special token's text is one token wherever it stands
            if PLAIN.fullmatch(text) and "<|" not in text:
                chunks = text.lower().split()
                found = list(map(self.chunks.get, chunks))
                if None in found:
                    found = [self._chunk(c) if x is None else x for c, x in zip(chunks, found)]
                n = len(first.split())
            else:
                found = [self._other(c.decode()) for c in text.encode().split()]
                n = len(first.encode().split())
            yield b"".join(found) + end, max(1, sum(map(len, found[:n])) // 4 if more else 1)

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        return (ids for ids, _ in self.examples(texts))


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """One tokenizer a Python worker, kept between its tasks."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_LOSS


class Shapes:
    """Examples by shape (tokens, loss): those of one shape are exchangeable,
    so the rule is evaluated once a shape, over arrays of the shapes in use."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.index: dict[tuple[int, int], int] = {}
        self.stacks: list[list[tuple[int, int]]] = []
        self.tokens, self.free, self.large = np.zeros(64), np.zeros(64), np.zeros(64, bool)

    def add(self, tokens: int, loss: int, example: tuple[int, int]) -> None:
        k = self.index.setdefault((tokens, loss), len(self.stacks))
        if k == len(self.stacks):
            self.stacks.append([])
            if k == self.tokens.size:
                self.tokens, self.free, self.large = (np.concatenate([x, np.zeros_like(x)]) for x in (self.tokens, self.free, self.large))
            self.tokens[k], self.free[k] = tokens, tokens - loss
            self.large[k] = tokens > self.limits.tokens or loss > self.limits.loss
        self.stacks[k].append(example)

    def best(self, room: int, room_loss: int) -> tuple[int, int] | None:
        """The shape with the largest dot product and the tokens to place of
        it: of those that fit whole or are larger than a sequence, else of
        all."""
        n = len(self.stacks)
        tokens, free = self.tokens[:n], self.free[:n]
        size = np.minimum(np.minimum(tokens, room), free + room_loss)
        product = size * (room / self.limits.tokens ** 2) + np.maximum(size - free, 0) * (room_loss / max(1, self.limits.loss) ** 2)
        first = np.where((size == tokens) | self.large[:n], product, 0.0)
        k = int(np.argmax(first))
        if first[k] <= 0:
            k = int(np.argmax(product))
        return (k, int(size[k])) if size[k] > 0 else None

    def take(self, k: int) -> tuple[int, int, tuple[int, int]]:
        tokens, loss = int(self.tokens[k]), int(self.tokens[k] - self.free[k])
        example = self.stacks[k].pop()
        if not self.stacks[k]:
            # the last shape takes the place of one out of use
            last = len(self.stacks) - 1
            del self.index[tokens, loss]
            if k < last:
                self.index[int(self.tokens[last]), int(self.tokens[last] - self.free[last])] = k
                self.stacks[k] = self.stacks[last]
                for x in (self.tokens, self.free, self.large):
                    x[k] = x[last]
            self.stacks.pop()
        return tokens, loss, example


def loss_of(start: int, length: int, tokens: int, loss: int) -> int:
    """Loss-bearing tokens of a piece of an example; they are its last."""
    return max(0, start + length - max(start, tokens - loss))


def pack(examples: list[tuple[int, int]], limits: Limits) -> Iterator[list[tuple[int, int, int]]]:
    """Examples (tokens, loss-bearing tokens, the last ones) -> sequences,
    each a list of pieces (example, start, length)."""
    n_max, shapes = limits.tokens, Shapes(limits)
    for i, (tokens, loss) in enumerate(examples):
        if tokens:
            shapes.add(tokens, loss, (i, 0))
    while shapes.stacks:
        room, slots, room_loss, pieces = n_max, limits.segments, limits.loss, []
        while room and slots and shapes.stacks:
            found = shapes.best(room, room_loss)
            if found is None:
                break
            k, size = found
            t, q, (i, start) = shapes.take(k)
            used = loss_of(0, size, t, q)
            if size < t:
                shapes.add(t - size, q - used, (i, start + size))
            pieces.append((i, start, size))
            room, slots, room_loss = room - size, slots - 1, room_loss - used
        if not pieces:
            raise ValueError("an example of one token exceeds the limits")
        yield pieces


def power_pieces(pieces: list[tuple[int, int, int]], n_max: int) -> Iterator[list[tuple[int, int, int]]]:
    """A sequence as it is if full, else cut into sequences whose lengths are
    powers of two, largest first."""
    left = sum(p[2] for p in pieces)
    if left == n_max or left & (left - 1) == 0:
        yield pieces
        return
    queue = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        out = []
        while size:
            i, start, length = queue.pop()
            take = min(size, length)
            out.append((i, start, take))
            if take < length:
                queue.append((i, start + take, length - take))
            size -= take
        yield out


def joined(pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Pieces with those that follow each other in an example made one."""
    out: list[tuple[int, int, int]] = []
    for i, start, length in sorted(pieces):
        if out and out[-1][0] == i and sum(out[-1][1:]) == start:
            out[-1] = (i, out[-1][1], out[-1][2] + length)
        else:
            out.append((i, start, length))
    return out


SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, sequence_tokens long, segment long, loss_tokens long")


class Part(NamedTuple):
    """What is to be packed of a document: its ids from ``start`` on."""
    doc_id: int | None
    start: int
    ids: bytes
    loss: int
    doc_tokens: int


def pack_documents(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """Documents (doc_id, text) -> one row per piece: doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens (length of
    the sequence), segment (place of the piece in it), loss_tokens (of the
    piece) and, ``with_ids``, the piece's ids."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def cut(part: Part, start: int, length: int) -> Part:
        loss = loss_of(start, length, len(part.ids) // 4, part.loss)
        return Part(part.doc_id, part.start + start, part.ids[4 * start:4 * (start + length)], loss, part.doc_tokens)

    def record(sequences: list[list[Part]], first: int) -> pa.RecordBatch:
        rows = []
        for at, parts in enumerate(sequences, first):
            total, offset = sum(len(p.ids) // 4 for p in parts), 0
            for segment, p in enumerate(parts):
                n = len(p.ids) // 4
                rows.append((p.doc_id, p.start, n, zlib.crc32(p.ids), p.doc_tokens, at, offset, total, segment, p.loss))
                offset += n
        cols = [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))]
        if not with_ids:
            return pa.record_batch(cols, names=names)
        blobs = [memoryview(p.ids).cast("I").tolist() for parts in sequences for p in parts]
        return pa.record_batch([*cols, pa.array(blobs, pa.list_(pa.int64()))], names=[*names, "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, sequence, rest = tokenizer_at(tokenizer), TaskContext.get().partitionId() << 40, []
        # None: the end of the task, which closes its last sequence too
        for batch in chain(batches, [None]):
            parts = rest
            if batch is not None:
                found = tok.examples(batch.column("text").to_pylist())
                parts = rest + [Part(d, 0, ids, len(ids) // 4 - free, len(ids) // 4)
                                for d, (ids, free) in zip(batch.column("doc_id").to_pylist(), found)]
            packed = list(pack([(len(p.ids) // 4, p.loss) for p in parts], limits))
            back, taken = [], 0
            while batch is not None and packed and taken < REST and sum(p[2] for p in packed[-1]) < limits.tokens:
                back += packed.pop()
                taken += 1
            rest = [cut(parts[i], start, length) for i, start, length in joined(back)]
            closed = [[cut(parts[i], start, length) for i, start, length in pieces]
                      for whole in packed for pieces in power_pieces(whole, limits.tokens)]
            yield record(closed, sequence)
            sequence += len(closed)

    schema = SCHEMA + (", ids array<long>" if with_ids else "")
    return in_arrow(docs.select("doc_id", "text"), run, schema)
