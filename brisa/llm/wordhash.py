"""Words of blocks of texts as 64-bit hashes, for whole Arrow columns at once.

A word is a run of bytes other than space and 0x09-0x0D; A-Z count as a-z. Its hash is a polynomial
of random values of its bytes, taken from running sums, then mixed. Two different words share a hash
with probability 2^-64, so what is counted with hashes is exact for all practical purposes."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a Python worker looks at in one go (one text at least).
BLOCK = 512 << 10
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def of_bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for every byte, capitals as small letters; and which bytes part words."""
    small = np.arange(256)
    small[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    return mixed(small.astype(np.uint64) + np.uint64(1)), space


#: Characters of one token in scripts written without spaces.
RUN = 3


@lru_cache(maxsize=1)
def unspaced() -> np.ndarray:
    """Whether two bytes begin a letter of a script written without spaces: Thai, Lao, Tibetan,
    Myanmar, Khmer, kana and Han."""
    out = np.zeros((256, 256), bool)
    for lead, first, last in [(0xE0, 0xB8, 0xBF), (0xE1, 0x80, 0x81), (0xE1, 0x9E, 0x9F), (0xE3, 0x81, 0x83), (0xE3, 0x90, 0xBF), (0xEF, 0xA4, 0xAB), (0xEF, 0xBD, 0xBE), (0xF0, 0xA0, 0xB3)]:
        out[lead, first:last + 1] = True
    out[0xE4:0xEA, 0x80:0xC0] = True
    return out


_powers = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE and its inverse to the powers 0 .. n-1; those of one block are kept."""
    global _powers
    up, down = _powers
    if len(up) < n:
        up, down = np.full(max(n, BLOCK), BASE), np.full(max(n, BLOCK), UNBASE)
        up[0] = down[0] = 1
        np.cumprod(up, dtype=np.uint64, out=up)
        np.cumprod(down, dtype=np.uint64, out=down)
        if len(up) <= 2 * BLOCK:
            _powers = up, down
    return up, down


def blocks(texts: pa.Array):
    """(bytes, where each text begins and the end) of runs of about BLOCK bytes of a string
    column; null counts as empty."""
    whole = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = whole.buffers()
    at = np.frombuffer(offsets, np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(whole):
        last = max(first + 1, int(np.searchsorted(at, at[first] + BLOCK, "right")) - 1)
        yield data[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def word_hashes(data: np.ndarray, at: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and where the words of each text begin (and the end)."""
    h, start = placed_words(data, at, runs)
    return h, np.searchsorted(start, at)


def character_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where all runs of RUN letters of scripts without spaces begin and end (the whole stretch of
    such letters if it is shorter), and which bytes belong to such letters."""
    first = np.flatnonzero(unspaced()[data[:-1], data[1:]]) if len(data) else np.zeros(0, np.int64)
    end = first + np.where(data[first] == 0xF0, 4, 3)
    of_them = np.zeros(len(data) + 1, np.int8)
    np.add.at(of_them, first, 1)
    np.add.at(of_them, end, -1)
    head = np.ones(len(first), bool)
    head[1:] = (first[1:] != end[:-1]) | (np.searchsorted(at, first[1:], "right") != np.searchsorted(at, first[:-1], "right"))
    heads = np.flatnonzero(head)
    bounds = np.append(heads, len(first))
    last = np.repeat(bounds[1:] - 1, np.diff(bounds)) if len(first) else first
    here = np.arange(len(first))
    whole = (here + RUN - 1 <= last) | head
    return first[whole], end[np.minimum(here + RUN - 1, last)][whole], np.cumsum(of_them[:-1]).astype(bool)


def placed_words(data: np.ndarray, at: np.ndarray, runs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a block, and the byte each begins at. No word crosses from one text
    into the next. With `runs`, letters of scripts without spaces are cut into runs of RUN."""
    value, space = of_bytes()
    n = len(data)
    inside = ~space[data]
    if runs:
        run_start, run_end, of_them = character_runs(data, at)
        inside &= ~of_them
    begins, ends = np.ones(n + 1, bool), np.ones(n + 1, bool)
    begins[1:] = ~inside
    begins[at] = True
    ends[:n] = ~inside
    ends[at] = True
    start = np.flatnonzero(begins[:n] & inside)
    end = np.flatnonzero(ends[1:] & inside) + 1
    if runs and len(run_start):
        start, end = np.concatenate([start, run_start]), np.concatenate([end, run_end])
        order = np.argsort(start, kind="stable")
        start, end = start[order], end[order]
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[data] * up[:n], out=total[1:])
    h = mixed((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return h, start


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words; of the whole sequence if it is shorter; none of none."""
    n = len(words)
    if n == 0:
        return words
    if n < width:                               # zeros stand for missing words
        return shingle_hashes(np.concatenate([words, np.zeros(width - n, np.uint64)]), width)
    h = np.zeros(n - width + 1, np.uint64)
    for k in range(width):
        h = h * np.uint64(0xD6E8FEB86659FD93) + words[k:n - width + 1 + k]
    return mixed(h)


def shingle_sets(texts: pa.Array, width: int, runs: bool = False):
    """The sorted distinct shingle hashes of each text, one array after the other."""
    for data, at in blocks(texts):
        words, first = word_hashes(data, at, runs)
        for a, b in zip(first[:-1], first[1:]):
            yield np.unique(shingle_hashes(words[a:b], width))
