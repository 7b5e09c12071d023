"""Deep-shallow sorting of suffixes to a depth, in numpy.

The shallow part is a multikey quicksort whose characters are 8-byte words:
suffixes are sorted by their first word, and ties by the next, to
``SHALLOW`` bytes. Groups that still tie have a long common prefix and go to
blind tries. A blind trie knows of each edge only the depth where it
branches and the first byte: a suffix is compared once with the reference
(first) suffix of its trie, falls to the branch (depth, byte) where it
differs, and is ordered among those of the same branch by a trie below. All
groups' tries grow together, a level a round.
"""
from __future__ import annotations

import numpy as np

WORD = 8
SHALLOW = 16


def words_at(data: np.ndarray) -> np.ndarray:
    """For each place of ``data`` (uint8) the big-endian number of the 8 bytes
    there; zero bytes follow the end."""
    x = np.concatenate([data, np.zeros(WORD, np.uint8)])
    two = (x[:-1].astype(np.uint16) << np.uint16(8)) | x[1:]
    four = (two[:-2].astype(np.uint32) << np.uint32(16)) | two[2:]
    return ((four[:-4].astype(np.uint64) << np.uint64(32)) | four[4:])[:data.size]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the runs of equal keys."""
    new = np.zeros(keys[0].size, bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def _first_difference(words: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, from SHALLOW bytes on
    and up to ``depth``."""
    lcp = np.full(a.size, depth, np.int64)
    left = np.arange(a.size)
    for at in range(SHALLOW, depth, WORD):
        x = words[a[left] + at] ^ words[b[left] + at]
        differ = x != 0
        if differ.any():
            # the highest byte that is set: its place from the left
            high = x[differ]
            byte = np.zeros(high.size, np.int64)
            for n in (4, 2, 1):
                zero = high >> np.uint64(64 - 8 * n) == 0
                byte[zero] += n
                high = np.where(zero, high << np.uint64(8 * n), high)
            lcp[left[differ]] = np.minimum(at + byte, depth)
        left = left[~differ]
        if not left.size:
            break
    return lcp


def deep_shallow(data: np.ndarray, places: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``data`` that start at ``places``, by their first
    ``depth`` bytes (all inside ``data``): the order, and a class number for
    each place in the order; suffixes equal to that depth share a class."""
    if not places.size:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    words = np.concatenate([words_at(data), np.zeros(depth + WORD, np.uint64)])
    order = np.argsort(words[places], kind="stable")
    keys = [words[places[order]]]
    for at in range(WORD, SHALLOW, WORD):
        group = _runs(*keys)
        tied = np.flatnonzero(np.bincount(group)[group] > 1)
        later = words[places[order] + at]
        inner = np.lexsort((later[tied], group[tied]))
        order[tied] = order[tied][inner]
        keys.append(words[places[order] + at])
    group = _runs(*keys).astype(np.int64)
    # blind tries of the tied groups
    spots = np.flatnonzero(np.bincount(group)[group] > 1)
    count = int(group[-1]) + 1
    node, sub = group[spots], order[spots]
    pending = np.arange(spots.size)
    # every round: compare with the node's first suffix, branch, sort
    position = spots.copy()
    while pending.size:
        g, s = node[pending], sub[pending]
        heads = np.concatenate(([True], g[1:] != g[:-1]))
        run = np.cumsum(heads) - 1
        ref = s[heads][run]
        lcp = _first_difference(words, places[s], places[ref], depth)
        equal = lcp >= depth
        at = np.minimum(lcp, depth - 1)
        mine, theirs = data[places[s] + at].astype(np.int64), data[places[ref] + at].astype(np.int64)
        # smaller branches: the earlier they leave the reference the smaller;
        # larger branches: the later they leave it the smaller
        edge = np.where(equal, (depth + 1) << 8, np.where(mine < theirs, (lcp << 8) | mine, ((3 * depth - lcp) << 8) | mine))
        inner = np.lexsort((edge, run))
        s, edge, run, equal = s[inner], edge[inner], run[inner], equal[inner]
        sub[pending] = s
        branch = _runs(run, edge)
        node[pending] = count + branch
        count += int(branch[-1]) + 1
        many = np.bincount(branch)[branch] > 1
        pending = pending[many & ~equal]
    order[spots] = sub
    group[spots] = node
    # nodes were numbered round by round: renumber along the order
    return order, _runs(group)
