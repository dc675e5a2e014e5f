"""Benchmark decontamination by the q-gram lemma.

An item of m characters with at most k edits keeps at least m - q + 1 - k q of its q-grams, all on diagonals
(document place minus item place) that span at most k + 1. So for each document: find the q-grams that any item has;
keep regions dense enough in them to hold an item of some length; there count each item's
distinct q-grams in overlapping diagonal bands of 2 (k + 1); and verify bands that reach the bound by banded
alignment of the whole item, free at the document's side.

k is EDIT_SHARE of the item's length. A document may also quote a part of an item: the same lemma holds for each stretch of
an item, at every place of it. A stretch has as many characters as would be a leak, but MIN_CHARS at least and STRETCH at
most; those that reach their bound in a band of their own k are aligned, and the share of the item's characters that lie
in any stretch found is its quoted share, wherever in the document the stretches are. An item is leaked if it is found
whole, or by a quoted share of QUOTED_SHARE or more, which is a parameter of find(). Characters are compared as code points after Unicode case folding, and each
ASCII white space character as a space.

Items are broadcast in blocks of about BLOCK_CHARS characters. A benchmark of one block, which is nearly any, needs one pass
over the documents and no shuffle. Further blocks have a pass each, whose few hits are written before the next block is
broadcast and the last one is destroyed, so that one block is in memory at a time; the hits are then joined to the documents.
A document's q-grams are counted band by band as its places go on, PAIRS of (place, item's place) at a time, so that long
texts of few different q-grams don't expand at once.

Defined cases: null and empty texts leak nothing; items that are null or shorter than min_chars (a parameter of find(), Q at
least) match nothing, being too short to tell a leak from chance, and so do quotes in pieces that are each shorter than a
stretch; equal items are each reported; repeated rows get equal results; only the named columns are used and replaced, so
further columns can't clash.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.llm.arrow_text import batches_of
from marlstream.llm.common import table, written
from marlstream.llm.hashing import mixed

Q = 8
EDIT_SHARE = 0.06
MIN_CHARS = 30
#: an item of which a document quotes this share of the characters is leaked
QUOTED_SHARE = 0.5
STRETCH = 50
BLOCK_CHARS = 4_000_000
#: pairs of places that are expanded at a time
PAIRS = 1 << 20
#: alignments of one item that are remembered for texts that repeat themselves
REMEMBERED = 10_000
#: lengths within one class of items differ by this factor at most
CLASS = 1.2
BATCH_BYTES = 4 << 20

_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[9:14] = 32


def characters(text: str) -> np.ndarray:
    """Folded code points."""
    x = np.frombuffer(text.casefold().encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(x < 128, _FOLD[np.minimum(x, 127)], x)


def grams(x: np.ndarray) -> np.ndarray:
    """A fingerprint of each Q = 8 characters in a row."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        h = h[:-step] * np.uint64(factor) + h[step:]
    return h


def facing(item: np.ndarray, doc: np.ndarray, low: int, high: int, k: int) -> np.ndarray:
    """What of doc an item may be aligned to on diagonals low .. high - 1 and k to either side, padded with no character."""
    low, high = low - k, high + k
    padded = np.full(len(item) + high - low, 0xFFFFFFFF, np.uint32)
    a, b = max(0, low), min(len(doc), low + len(padded))
    if b > a:
        padded[a - low : b - low] = doc[a:b]
    return padded


def edits_within(item: np.ndarray, padded: np.ndarray, k: int) -> int | None:
    """The least number of edits that align the whole item to some stretch of doc, on the diagonals that facing(item, doc, low, high, k) is for,
    or None if that is over k."""
    width, m = len(padded) - len(item), len(item)
    ramp = np.arange(width)
    cost = np.zeros(width, np.int64)
    for i in range(m):
        best = cost + (padded[i : i + width] != item[i])
        best[:-1] = np.minimum(best[:-1], cost[1:] + 1)
        cost = np.minimum.accumulate(best - ramp) + ramp
        if cost.min() > k:
            return None
    return int(cost.min())


def stretches_within(item: np.ndarray, starts: np.ndarray, length: int, padded: np.ndarray, k: int) -> np.ndarray:
    """Those starts whose `length` characters of the item align to some stretch of doc with at most k edits, on the diagonals
    that facing(item, doc, low, high, k) is for."""
    width = len(padded) - len(item)
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    ramp = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(starts), width), np.int32)
    for i in range(length):
        best = cost + (windows[starts + i] != item[starts + i, None])
        best[:, :-1] = np.minimum(best[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(best - ramp, axis=1) + ramp
    return starts[cost.min(axis=1) <= k]


def distinct_rows(rows: np.ndarray) -> np.ndarray:
    """The distinct rows of three integers, sorted; as single integers if they fit."""
    if not len(rows):
        return rows
    low = rows.min(axis=0)
    span = [int(x) + 1 for x in rows.max(axis=0) - low]
    if span[0] * span[1] * span[2] >= 1 << 62:
        return np.unique(rows, axis=0)
    x = rows - low
    x = np.unique((x[:, 0] * span[1] + x[:, 1]) * span[2] + x[:, 2])
    return np.stack([x // (span[1] * span[2]), x // span[2] % span[1], x % span[2]], axis=1) + low


def covered(starts: np.ndarray, length: int, size: int) -> int:
    """How many of an item's characters lie in stretches with these starts."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(starts + length, minlength=size + 1)
    return int((np.cumsum(change) > 0).sum())


class Items:
    """One block of items with its q-gram index."""

    BITS = 22

    def __init__(self, rows: list[tuple[int, str]], share: float = QUOTED_SHARE, min_chars: int = MIN_CHARS):
        self.share, self.min_chars = share, max(Q, min_chars)
        texts = [(i, characters(t)) for i, t in rows if t is not None]
        self.items = [(i, x) for i, x in texts if len(x) >= self.min_chars]
        self.size = size = np.array([len(x) for _, x in self.items], np.int64)
        self.edits = np.minimum(np.floor(size * EDIT_SHARE).astype(np.int64), (size - Q) // Q)
        self.least = size - Q + 1 - self.edits * Q
        self.stretch = np.clip(np.ceil(size * share).astype(np.int64), self.min_chars, max(STRETCH, self.min_chars))
        self.slack = np.minimum(np.floor(self.stretch * EDIT_SHARE).astype(np.int64), (self.stretch - Q) // Q)
        self.rich = self.stretch - Q + 1 - self.slack * Q
        self.classes = self._classes(size, self.edits, self.least) + self._classes(self.stretch, self.slack, self.rich)
        gram = np.concatenate([grams(x) for _, x in self.items]) if self.items else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(size)), np.maximum(0, size - Q + 1))
        place = np.concatenate([np.arange(len(x) - Q + 1) for _, x in self.items]) if self.items else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.bitmap = np.zeros(1 << self.BITS, bool)
        self.bitmap[self._slot(self.gram)] = True

    def _slot(self, gram: np.ndarray) -> np.ndarray:
        return (mixed(gram) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def _classes(self, size: np.ndarray, edits: np.ndarray, least: np.ndarray) -> list[tuple[int, int]]:
        """(window, least): an item, or stretch, of a class of similar lengths has at least `least` of its q-grams in one
        window."""
        found, order = [], np.argsort(size)
        while len(order):
            own = order[size[order] <= CLASS * size[order[0]]]
            found.append((int((size[own] + edits[own]).max()) - Q + 1, int(least[own].min())))
            order = order[len(own) :]
        return found

    def _dense_hits(self, x: np.ndarray) -> np.ndarray:
        """Places whose q-gram some item has, in regions that might hold an item."""
        gram = grams(x)
        hit = self.bitmap[self._slot(gram)]
        total = np.concatenate([[0], np.cumsum(hit)])
        n, change = len(gram), None
        for window, least in self.classes:
            if total[-1] < least:
                continue
            w = min(window, n)
            rich = np.flatnonzero(total[w:] - total[: n - w + 1] >= least)
            if len(rich):
                change = np.zeros(n + 1, np.int64) if change is None else change
                change += np.bincount(rich, minlength=n + 1) - np.bincount(rich + w, minlength=n + 1)
        if change is None:
            return np.zeros(0, np.int64)
        return np.flatnonzero(hit & (np.cumsum(change[:-1]) > 0))

    def _hits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place, first, n): places whose q-gram items have, in regions that might hold one, and where the n places of
        items with this q-gram begin in the index."""
        if not self.items or len(x) < max(Q, self.min_chars - self.edits.max()):
            return None
        at = self._dense_hits(x)
        gram = grams(x)[at]
        first, last = np.searchsorted(self.gram, gram, "left"), np.searchsorted(self.gram, gram, "right")
        some = last > first
        return (at[some], first[some], (last - first)[some]) if some.any() else None

    def _bands(self, hits, asked: np.ndarray, edits: np.ndarray, least: np.ndarray):
        """(item, low, places) of each diagonal band of 2 (k + 1) from low that has at least `least` distinct places of an
        item that is asked for. A band is told as soon as no later place can be in it. The caller may ask for fewer items
        as it goes on."""
        at, first, n = hits
        upto = np.concatenate([[0], np.cumsum(n)])
        open_ = np.zeros((0, 3), np.int64)
        begin = 0
        while begin < len(at) and asked.any():
            stop = max(begin + 1, int(np.searchsorted(upto, upto[begin] + PAIRS, "right")) - 1)
            count = n[begin:stop]
            row = np.repeat(first[begin:stop] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            item, place, of = self.item[row], self.place[row], np.repeat(at[begin:stop], count)
            own = asked[item]
            item, place, of = item[own], place[own], of[own]
            band = (of - place) // (edits[item] + 1)
            key = np.stack([np.tile(item, 2), np.concatenate([band, band - 1]), np.tile(place, 2)], axis=1)
            key = distinct_rows(np.concatenate([open_, key]))
            begin = stop
            if begin < len(at):
                over = (key[:, 1] + 2) * (edits[key[:, 0]] + 1) + self.size[key[:, 0]] < at[begin]
                open_, key = key[~over], key[over]
            change = np.flatnonzero(np.any(np.diff(key[:, :2], axis=0) != 0, axis=1)) + 1
            edge = np.concatenate([[0], change, [len(key)]])
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                i = int(key[a, 0]) if b > a else 0
                if b > a and b - a >= least[i]:
                    yield i, int(key[a, 1]) * (int(edits[i]) + 1), key[a:b, 2]

    def leaks(self, text: str) -> tuple[dict[int, int], dict[int, float]]:
        """(number of each item found whole -> edits, number of each other item leaked -> its quoted share)."""
        x = characters(text)
        hits = self._hits(x)
        if hits is None:
            return {}, {}
        found: dict[int, int] = {}
        done: dict[int, set] = {}
        asked = np.ones(len(self.items), bool)
        for i, low, _ in self._bands(hits, asked, self.edits, self.least):
            if found.get(i) == 0:
                continue
            k = int(self.edits[i])
            padded = facing(self.items[i][1], x, low, low + 2 * (k + 1), k)
            if not self._is_new(done, i, padded):
                continue
            edits = edits_within(self.items[i][1], padded, k)
            if edits is not None:
                found[i] = min(edits, found.get(i, k))
                asked[i] = edits > 0
        rest = np.ones(len(self.items), bool)
        rest[list(found)] = False
        return found, self._quoted(x, hits, rest)

    @staticmethod
    def _is_new(done: dict[int, set], i: int, *arrays: np.ndarray) -> bool:
        known, what = done.setdefault(i, set()), hashlib.blake2b(b"".join(x.tobytes() for x in arrays), digest_size=16).digest()
        if what in known:
            return False
        if len(known) < REMEMBERED:
            known.add(what)
        return True

    def _quoted(self, x: np.ndarray, hits, rest: np.ndarray) -> dict[int, float]:
        """Number of each item of which the document quotes the share that counts -> share."""

        def rich_starts(asked):
            for i, low, places in self._bands(hits, asked, self.slack, self.rich):
                total = np.concatenate([[0], np.cumsum(np.bincount(places, minlength=int(self.size[i]) - Q + 1))])
                window = int(self.stretch[i]) - Q + 1
                starts = np.flatnonzero(total[window:] - total[:-window] >= self.rich[i])
                if len(starts):
                    yield i, low, starts

        # what might be quoted must be enough before anything is aligned
        might: dict[int, np.ndarray] = {}
        for i, _, starts in rich_starts(rest):
            might.setdefault(i, np.zeros(int(self.size[i] - self.stretch[i]) + 1, bool))[starts] = True
            rest[i] = not might[i].all()
        enough = lambda i, at: covered(at, int(self.stretch[i]), int(self.size[i])) >= self.share * self.size[i]
        asked = np.zeros(len(self.items), bool)
        asked[[i for i, starts in might.items() if enough(i, np.flatnonzero(starts))]] = True
        if not asked.any():
            return {}
        held = {int(i): np.zeros(len(might[i]), bool) for i in np.flatnonzero(asked)}
        done: dict[int, set] = {}
        for i, low, starts in rich_starts(asked):
            left = starts[~held[i][starts]]
            if not len(left):
                continue
            whole, k = self.items[i][1], int(self.slack[i])
            padded = facing(whole, x, low, low + 2 * (k + 1), k)
            if self._is_new(done, i, padded, left):
                held[i][stretches_within(whole, left, int(self.stretch[i]), padded, k)] = True
                asked[i] = not held[i].all()
        return {i: covered(np.flatnonzero(at), int(self.stretch[i]), int(self.size[i])) / int(self.size[i]) for i, at in held.items() if at.any() and enough(i, np.flatnonzero(at))}


LISTS = {"__items": T.LongType(), "__edits": T.IntegerType(), "__quoted": T.LongType(), "__shares": T.DoubleType()}


def _lists(known: Items, text: str | None) -> list[list]:
    """What LISTS holds for a text: items found whole and their edits, items quoted and their shares."""
    out = []
    for found in known.leaks(text or ""):
        pairs = sorted((known.items[i][0], v) for i, v in found.items())
        out += [[i for i, _ in pairs], [v for _, v in pairs]]
    return out


def _pass(docs: DataFrame, shared, only_hits: bool) -> DataFrame:
    """docs with LISTS; with only_hits the rows that have any."""
    schema = T.StructType(list(docs.schema.fields))
    for c, kind in LISTS.items():
        schema = schema.add(c, T.ArrayType(kind))

    def run(batches):
        known = shared.value
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                found = [_lists(known, x) for x in batch.column("text").to_pylist()]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
                more = [pa.array([x[i] for x in found], pa.list_(kind)) for i, kind in enumerate(kinds)]
                out = pa.RecordBatch.from_arrays([*batch.columns, *more], schema.names)
                yield out.filter(pa.array([bool(x[0] or x[2]) for x in found], pa.bool_())) if only_hits else out

    return docs.mapInArrow(run, schema)


def find(docs: DataFrame, benchmark: DataFrame, share: float = QUOTED_SHARE, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with item_ids (sorted) of the items found whole and the edits of each, and quoted_ids (sorted) of others of
    which at least `share` is quoted and the quoted_shares; the other columns stay."""
    context = docs.sparkSession.sparkContext
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_CHARS))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("item_ids", "edits", "quoted_ids", "quoted_shares")]
    own = docs.select(*rest)

    def block(b: int) -> Items:
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        return Items(sorted((r.item_id, r.text) for r in rows), share, min_chars)

    if blocks == 1:
        state = _pass(own, context.broadcast(block(0)), False)
    else:
        # a text's result doesn't depend on its row, so hits are joined by two hashes of the text
        key = {"__t1": F.xxhash64("text"), "__t2": F.xxhash64(F.lit(1), "text")}
        hits = []
        for b in range(blocks):
            shared = context.broadcast(block(b))
            hits.append(written(_pass(own.select("text"), shared, True).select(*[v.alias(k) for k, v in key.items()], *LISTS).dropDuplicates(list(key))))
            shared.destroy()
        every = functools.reduce(DataFrame.unionByName, hits)
        joined = every.groupBy(*key).agg(F.collect_list(F.struct(*LISTS)).alias("all")).select(*key, *[F.flatten(F.col("all")[c]).alias(c) for c in LISTS])
        none = [F.coalesce(c, F.array().cast(T.ArrayType(kind))).alias(c) for c, kind in LISTS.items()]
        state = own.withColumns(key).join(written(joined), list(key), "left").select(*rest, *none)
    state = state.withColumn("__whole", F.array_sort(F.arrays_zip("__items", "__edits"))).withColumn("__parts", F.array_sort(F.arrays_zip("__quoted", "__shares")))
    return state.select(*rest, F.col("__whole.__items").alias("item_ids"), F.col("__whole.__edits").alias("edits"), F.col("__parts.__quoted").alias("quoted_ids"), F.col("__parts.__shares").alias("quoted_shares"))


def op10_decontaminate(spark, sf_dir):
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n = F.size("item_ids") + F.size("quoted_ids")
    return found.select("doc_id", (n > 0).alias("leaked"), n.cast("long").alias("n_items"), "item_ids", "edits", "quoted_ids", "quoted_shares")


def drop_leaks(spark, docs, sf_dir):
    """Pipeline stage: documents that hold a benchmark item within its edit budget, or quote the share that counts, go."""
    found = find(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("item_ids") + F.size("quoted_ids") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


QUERIES = {"op10_decontaminate": op10_decontaminate}
