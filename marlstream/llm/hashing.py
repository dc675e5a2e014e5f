"""Words of UTF-8 bytes and their 64-bit fingerprints, over all texts of a batch at once."""

from __future__ import annotations

import numpy as np

SEPARATORS = np.zeros(256, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: bases of independent fingerprints
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = BASES[0]) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(max(1, n), np.uint64)
    done = 1
    while done < n:
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
        done += step
    return out


def coefficients(n: int, seed: int) -> np.ndarray:
    """n odd multipliers that are the same everywhere."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(int(seed) * 0x632BE59BD9B4E019 % (1 << 64))) | np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of each word, in order; a word never crosses texts."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inner = ~SEPARATORS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, ~inner[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, ~inner[1:]
    start = np.flatnonzero(inner & (before | cut[:-1]))
    end = np.flatnonzero(inner & (after | cut[1:])) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, number: int = 0) -> np.ndarray:
    """A fingerprint of each word's bytes; those of another number are independent of it."""
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    total = int(length.sum())
    first = np.cumsum(length) - length
    place = np.arange(total) - np.repeat(first, length)
    at = place + np.repeat(start, length)
    byte = data[at].astype(np.uint64) + np.uint64(1) if number == 0 else coefficients(256, 90 + number)[data[at]]
    value = byte * powers(int(length.max()), BASES[number])[place]
    return mixed(np.add.reduceat(value, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def sequence_hashes(symbols: np.ndarray, width: int, seed: int) -> np.ndarray:
    """A fingerprint of each `width` symbols in a row."""
    n = len(symbols) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    for j, c in enumerate(coefficients(width, seed)):
        out += symbols[j : j + n] * c
    return mixed(out)
