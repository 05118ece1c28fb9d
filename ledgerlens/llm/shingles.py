"""Word shingles of whole texts as 64-bit hashes, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_RANDOM = np.random.default_rng(20240601)
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PLACE = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, and the number of words of each text."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + len(column) + 1]
    raw = column.buffers()[2]
    text = np.frombuffer(raw, np.uint8)[offsets[0]: offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    cuts = offsets - offsets[0]
    inside = np.concatenate([_WORD[text], [False]])
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at_cut = cuts[:-1][cuts[:-1] < len(text)]
    first[at_cut] = inside[at_cut]
    starts = np.flatnonzero(first)
    stop = ~inside
    stop[at_cut] = True
    stop[-1] = True
    stops = np.flatnonzero(stop)
    lengths = stops[np.searchsorted(stops, starts, "right")] - starts
    order = np.argsort(-lengths, kind="stable")
    begin, length = starts[order], lengths[order]
    h = np.zeros(len(order), np.uint64)
    live = len(order)
    for k in range(int(length[0]) if live else 0):
        live = int(np.searchsorted(-length[:live], -k, "left"))
        h[:live] = h[:live] * _STEP + _BYTE[_FOLD[text[begin[:live] + k]]]
    words = np.empty_like(h)
    words[order] = mixed(h + length.astype(np.uint64))
    return words, np.diff(np.searchsorted(starts, cuts))


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, one text after the other, and their numbers.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A text of fewer than ``width`` words has
    its whole sequence as its one shingle; one without words, none.
    """
    words, counts = word_hashes(column)
    begin = np.cumsum(counts) - counts
    per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), per)
    at = begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    size = np.minimum(counts, width)[owner]
    h = np.zeros(len(owner), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        h += np.where(size > k, padded[at + k] * _PLACE[k], np.uint64(0))
    h = mixed(h + size.astype(np.uint64))
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(counts))


def shared_counts(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, pair by pair."""
    n = len(left[1])
    owner = np.concatenate([np.repeat(np.arange(n), left[1]), np.repeat(np.arange(n), right[1])])
    h = np.concatenate([left[0], right[0]])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    both = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][both], minlength=n)
