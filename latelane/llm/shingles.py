"""Word shingles of whole batches of texts as sorted 64-bit hashes, without a loop over words."""

from __future__ import annotations

import numpy as np

from latelane.llm.common import mixed, prefix_sums, range_hashes

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_PLACES = mixed(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (A-Z lowered) in order, and where each text's words start."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    word = ~_IS_SPACE[data]
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return range_hashes(prefix_sums(_LOWER[data]), starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of ``width`` words per text, ascending, and the ``n + 1`` bounds of the texts' sets.

    A text with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    words, bounds = word_hashes(data, offsets)
    n_words = np.diff(bounds)
    sizes = np.where(n_words >= width, n_words - width + 1, (n_words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(sizes)])
    values = np.zeros(at[-1], np.uint64)
    place = np.repeat(bounds[:-1] - at[:-1], sizes) + np.arange(at[-1])
    full = np.repeat(n_words >= width, sizes)
    total = np.zeros(int(full.sum()), np.uint64)
    for j in range(width):
        total += words[place[full] + j] * _PLACES[j]
    values[full] = total
    for m in range(1, width):
        short = np.flatnonzero(n_words == m)
        total = np.full(len(short), m, np.uint64) * np.uint64(0xA24BAED4963EE407)
        for j in range(m):
            total += words[bounds[short] + j] * _PLACES[j]
        values[at[short]] = total
    values = mixed(values)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        values[a:b].sort()
    if not len(values):
        return values, at
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[at[:-1][sizes > 0]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[at]
