"""Words and word-gram hashes of UTF-8 texts, for whole Arrow batches at once.

A word is a run of the bytes 0-9, a-z and 0x80-0xFF after A-Z became a-z; that equals
the pattern ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` over characters.
"""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[65:91] = _IS_WORD[128:] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = max(n, 1 << 16)
        table = np.full(size, base, np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if size <= 1 << 21:  # longer ones are made anew, not kept
            _powers[base] = table
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (xor-shift and multiply) so that all bits depend on all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and n + 1 word offsets by text."""
    n_texts = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    is_word = _IS_WORD[data]
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = is_word[cuts]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    before = cuts[cuts > 0] - 1
    last[before] = is_word[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LOWER[data].astype(np.uint64) * _power_table(_BASE, len(data))[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power_table(_BASE_INVERSE, len(data))[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, offsets, "left").astype(np.int64)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position, across text ends too; n - k + 1 values."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(_GRAM) + words[j : j + n]
    return mix(out)


def gram_owner(word_offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions of the grams that lie inside one text, and those texts' indices."""
    counts = np.maximum(np.diff(word_offsets) - k + 1, 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return np.arange(len(owner)) - begin[owner] + word_offsets[:-1][owner], owner


#: Longer texts are split into words piece by piece, each cut behind a byte of no word.
_PIECE = 1 << 22


def text_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """split_words with bounded working memory for a very long single text."""
    if len(data) <= 2 * _PIECE or len(offsets) != 2:
        return split_words(data, offsets)
    parts, at = [], 0
    while at < len(data):
        end = min(at + _PIECE, len(data))
        while end < len(data) and _IS_WORD[data[end - 1]] and _IS_WORD[data[end]]:
            end += 1
        parts.append(split_words(data[at:end], np.array([0, end - at]))[0])
        at = end
    words = np.concatenate(parts)
    return words, np.array([0, len(words)], np.int64)
