"""Repeated windows found through anchors: what the two substring operators share.

A window is `width` symbols in a row. Each window has an anchor inside it that depends on its symbols alone, so
equal windows have equal anchors at equal offsets. Consecutive windows with one anchor are one row:

    a      fingerprint of the anchor        r, s   two independent fingerprints of all symbols that its windows cover
    doc    the document's id                tag    64-bit hash of its text, for rows that repeat an id
                                            place  start of the first window and number of windows

Symbols are equal if r and s are, 128 bits in all. Anchors that occur once are dropped. Where all rows of an anchor cover equal symbols (one r), their windows repeat
as a whole; only where r differs must single windows be looked at, and there only the first row of each r.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.llm.common import BROADCAST_IDS, dropped, written
from marlstream.llm.hashing import BASES, mixed, powers

COUNT_BITS = 12
MOST_WINDOWS = (1 << COUNT_BITS) - 1
#: the place of a text that is covered as a whole
WHOLE = -1


class Stretches:
    """Fingerprints of any stretches of a symbol sequence; those of another number are independent if the symbols' names
    are."""

    def __init__(self, names: np.ndarray, number: int = 0):
        base = BASES[number]
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * powers(len(names), base)[: len(names)], dtype=np.uint64)])
        self.back = powers(len(names) + 1, pow(base, -1, 1 << 64))

    def hashes(self, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
        length = (end - start).astype(np.uint64)
        return mixed((self.sums[end] - self.sums[start]) * self.back[start] + length * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))


def windows_of(n: np.ndarray, width: int) -> np.ndarray:
    """Starts of all windows, n being the texts' numbers of symbols in one sequence."""
    first = np.cumsum(n) - n
    count = np.maximum(0, n - width + 1)
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)


def runs_of(starts: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) positions of each maximal run of consecutive windows with one anchor, of MOST_WINDOWS at most."""
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) != 1) | (np.diff(anchor) != 0)
    first = np.flatnonzero(new)
    length = np.diff(np.append(first, len(starts)))
    if length.max() > MOST_WINDOWS:
        first = np.concatenate([np.arange(f, f + n, MOST_WINDOWS) for f, n in zip(first, length, strict=True)])
    return first, np.append(first[1:], len(starts)) - 1


def doc_key() -> Column:
    """A null id comes before all others."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long"))


def tag() -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64("text")


def once(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (doc, tag, text) with one row for all that are equal, and the keys (doc, tag) that had several. Of texts, only
    those of such keys are shuffled, one from each task at most."""
    again = written(docs.groupBy("doc", "tag").agg(F.count("*").alias("n")).where("n > 1").select("doc", "tag"))
    n = again.count()
    if not n:
        return docs, again
    keys = F.broadcast(again) if n <= BROADCAST_IDS else again
    one = written(docs.join(keys, ["doc", "tag"], "left_semi").groupBy("doc", "tag").agg(F.min("text").alias("text")))
    return docs.join(keys, ["doc", "tag"], "left_anti").unionByName(one), again


def packed(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << COUNT_BITS) | count.astype(np.int64)


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, count)"""
    return place >> COUNT_BITS, place & MOST_WINDOWS


def with_places(docs: DataFrame, places: DataFrame, how: str = "inner") -> DataFrame:
    """docs (doc, tag, ...) with the column `places` of by_document()."""
    return docs.join(places, (F.col("doc") == F.col("__doc")) & (F.col("tag") == F.col("__tag")), how).drop("__doc", "__tag")


def repeated(rows: DataFrame) -> DataFrame:
    """Of rows (a, r, s, doc, tag, place) those whose anchor occurs more than once, with `many`: if its r or s differ. The
    group-by is pre-aggregated and written, so that the join back to the rows can be split where an anchor is hot."""
    rs = F.struct("r", "s")
    groups = written(rows.groupBy("a").agg(F.count("*").alias("n"), (F.min(rs) != F.max(rs)).alias("many")).where("n > 1").select("a", "many"))
    found = written(rows.join(groups, "a"))
    dropped(groups)
    return found


def first_places(rows: DataFrame) -> DataFrame:
    """(a, r, s, many, doc, place, tag, n): of equal rows the first, and how many there are."""
    first = rows.groupBy("a", "r", "s").agg(F.min(F.struct("doc", "place", "tag")).alias("f"), F.count("*").alias("n"), F.first("many").alias("many"))
    return written(first.select("a", "r", "s", "many", "f.doc", "f.place", "f.tag", "n"))


def by_document(places: DataFrame, value: Column | str = "place") -> DataFrame:
    """(__doc, __tag, places): a document's rows together; as many as it has anchors at most."""
    return places.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list(value).alias("places"))


def covered(n: int, places, width: int) -> np.ndarray:
    """Which of a document's n symbols its places cover."""
    mask = np.zeros(n + 1, np.int64)
    if places is not None and len(places):
        places = np.asarray(places, np.int64)
        if places.min() == WHOLE:
            return np.ones(n, bool)
        start, count = unpacked(places)
        np.add.at(mask, start, 1)
        np.add.at(mask, np.minimum(n, start + count - 1 + width), -1)
    return np.cumsum(mask[:-1]) > 0
