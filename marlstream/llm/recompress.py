"""Recompression of token sequences, over all texts of a batch at once.

A round names runs of one symbol, then pairs. Every symbol is put on the left or the right side by a bit of its
name, and each left symbol that stands before a right one becomes a pair with it. A name is a fingerprint of what it
stands for, so that equal stretches get equal names in all tasks, without a dictionary. Only near its ends can a
stretch be named otherwise in another context: with every symbol goes the stretch of tokens that its being there
depends on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from marlstream.llm.hashing import coefficients, mixed

#: no token stretch holds these: what depends on the end of a text
BEFORE, AFTER = -(1 << 40), 1 << 40


@dataclass
class Symbols:
    """In order: name, text number, and the tokens [low, high) that make it be there."""

    name: np.ndarray
    text: np.ndarray
    low: np.ndarray
    high: np.ndarray


def tokens(names: np.ndarray, text: np.ndarray) -> Symbols:
    at = np.arange(len(names), dtype=np.int64)
    return Symbols(names, text, at, at + 1)


def _neighbours(s: Symbols) -> tuple[np.ndarray, np.ndarray]:
    """The low of the symbol before each, and the high of the one after."""
    before, after = np.full(len(s.name), BEFORE), np.full(len(s.name), AFTER)
    same = s.text[1:] == s.text[:-1]
    before[1:][same] = s.low[:-1][same]
    after[:-1][same] = s.high[1:][same]
    return before, after


def name_runs(s: Symbols, seed: int) -> Symbols:
    if not len(s.name):
        return s
    new = np.ones(len(s.name), bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.text[1:] != s.text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    n = (last - first + 1).astype(np.uint64)
    before, after = _neighbours(s)
    name = np.where(n > 1, mixed(s.name[first] + n * coefficients(1, seed)[0]), s.name[first])
    return Symbols(name, s.text[first], before[first], after[last])


def name_pairs(s: Symbols, seed: int) -> Symbols:
    if not len(s.name):
        return s
    left = (mixed(s.name + coefficients(1, seed)[0]) & np.uint64(1)).astype(bool)
    pair = np.zeros(len(left), bool)
    pair[:-1] = left[:-1] & ~left[1:] & (s.text[1:] == s.text[:-1])
    second = np.zeros(len(left), bool)
    second[1:] = pair[:-1]
    before, after = _neighbours(s)
    low, high = np.where(left, s.low, before), np.where(left, after, s.high)
    at = np.flatnonzero(pair)
    low[at], high[at] = s.low[at], s.high[at + 1]
    a, b = coefficients(2, seed + 1)
    name = s.name.copy()
    name[at] = mixed(s.name[at] * a + s.name[at + 1] * b)
    keep = ~second
    return Symbols(name[keep], s.text[keep], low[keep], high[keep])


def levels(names: np.ndarray, text: np.ndarray, rounds: int) -> list[Symbols]:
    """The tokens, and the symbols after each round."""
    found = [tokens(names, text)]
    for r in range(rounds):
        found.append(name_pairs(name_runs(found[-1], 100 + 3 * r), 101 + 3 * r))
    return found


def anchors(level: Symbols, starts: np.ndarray, width: int) -> np.ndarray:
    """For each window [start, start + width), start ascending, the number of the symbol of least priority among those
    that the window's tokens alone make be there, the leftmost of equals; -1 if there is none."""
    out = np.full(len(starts), -1, np.int64)
    if not len(starts) or not len(level.name):
        return out
    # low and high ascend but for the marks of a text's ends, which no window holds
    inside = np.flatnonzero((level.low >= 0) & (level.high < AFTER))
    if not len(inside):
        return out
    low, high = level.low[inside], level.high[inside]
    first = np.searchsorted(low, starts, "left")
    last = np.searchsorted(high, starts + width, "right")
    n = last - first
    some = np.flatnonzero(n > 0)
    if not len(some):
        return out
    rank = mixed(level.name[inside])
    size = n[some]
    power = np.frexp(size.astype(np.float64))[1] - 1
    best = np.empty(len(some), np.int64)
    # least[i] is the number of the symbol of least rank among 2 ** k from i on, the leftmost of equals
    least = np.arange(len(inside))
    for k in range(int(power.max()) + 1):
        if k:
            half = 1 << (k - 1)
            if len(least) > half:
                x, y = least[:-half], least[half:]
                least = np.where(rank[y] < rank[x], y, x)
        own = np.flatnonzero(power == k)
        i = some[own]
        x, y = least[first[i]], least[last[i] - (1 << k)]
        best[own] = np.where(rank[y] < rank[x], y, x)
    out[some] = inside[best]
    return out
