"""Words of many texts at once, found on their UTF-8 bytes with numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: A-Z to a-z; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text: digits, a-z, and all bytes of characters beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words of letters: a-z, and all bytes of characters beyond ASCII.
LETTERS = ALNUM.copy()
LETTERS[48:58] = False

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each maximal run of ``in_word`` bytes; a run ends where its text ends."""
    n = len(data)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    inside = in_word[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the finaliser of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same in every batch and process."""
    size = ends - starts
    short = size.astype(np.int16) if not len(size) or size.max() < 1 << 15 else size
    order = np.argsort(short, kind="stable")  # shortest first, so that the words with a k-th byte are the last ones
    at, left = starts[order], size[order]
    h = left.astype(np.uint64) * MULTIPLIER
    k = 0
    while True:
        m = int(np.searchsorted(left, k, "right"))
        if m >= len(h):
            break
        rest = h[m:]
        rest ^= data.take(at[m:])
        rest *= np.uint64(0x100000001B3)
        at[m:] += 1
        k += 1
    out = np.empty(len(h), np.uint64)
    out[order] = mixed(h)
    return out


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of each ``k`` consecutive word hashes, order counted; empty if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x5851F42D4C957F2D) + h[i : i + n]
    return mixed(out)


def bounds(text_no: np.ndarray, texts: int) -> np.ndarray:
    """Where each text's words begin in a word array sorted by text: ``texts + 1`` positions."""
    return np.searchsorted(text_no, np.arange(texts + 1))


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The strings that lie one after the other in ``data``, without a copy of it."""
    offsets = np.ascontiguousarray(offsets, np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded_words(data: np.ndarray, offsets: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code, text number) of each word and the distinct words that the codes stand for."""
    starts, ends, text_no = words(data, offsets, in_word)
    coded = strings(data[in_word[data]], np.concatenate([[0], np.cumsum(ends - starts)])).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), text_no, coded.dictionary
