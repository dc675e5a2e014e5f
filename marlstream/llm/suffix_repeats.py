"""Substring dedup over bytes by external induced sorting.

A byte is removed if a string of WIDTH bytes covers it that also starts anywhere else. Only suffixes cut after WIDTH
bytes have to be told apart, and induced sorting needs to sort a sample of them only:

1. Sampling by recursion (in the tasks, text by text): a suffix is sampled if the 8-byte name at its start is a local
   minimum among its neighbours; of the sampled ones the local minima are sampled again, LEVELS times. With each
   sample goes the stretch of bytes [low, high) that alone makes it be one. Every string of WIDTH bytes is induced
   from one sample inside it: the least of the highest level, the leftmost of equals. Consecutive strings of one
   sample are one tuple (a, r, s, doc, tag, place): a names the sample by its stretch, and r and s, of different bases
   and symbols, all bytes that its strings cover. Bytes are equal if both are, 128 bits in all.
2. Sorting: Spark sorts the tuples, spilling sorted runs to disk and merging them. The order goes on to the last
   column, so that a sample with a third of all tuples is spread over many tasks. Suffixes are thus ordered by the names
   of their stretches, not by their bytes: equal ones meet, and that is all that is asked. The common prefix of
   neighbours is known in three steps: over all strings of the tuple (r, s equal: all repeat), into the sample (a equal:
   some may repeat) or less (none does). Tasks keep one run at a time; what lies at their ends is compared after.
3. Induction: only tuples whose neighbours have a, but not r and s, are undecided; of equal tuples a few stand for
   all. They are cut into blocks of BLOCK strings by the distance from the sample, so that equal strings are in equal
   blocks. All strings of a block have its core in common: blocks (core, all bytes covered) are sorted and compared
   likewise, and the single strings of those that are still undecided after that.

Per-suffix tuples for all suffixes, as a whole suffix array has them, would alone be 16 bytes or more for each byte of
the corpus; the sampled ones are about a fifth of a byte.

Defined cases: a null or empty text has no bytes; texts of fewer than WIDTH bytes lose nothing; rows that repeat an id,
and rows without one, are documents of their own, so that texts of WIDTH bytes or more in repeated rows are removed
whole (equal rows are sorted as one, and their number changes nothing); only the named columns are used, so further
columns can't clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.llm import anchored
from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, table, written
from marlstream.llm.hashing import coefficients, mixed

WIDTH = 400
LEVELS = 3
NAME = 8
BLOCK = 32
BATCH_BYTES = 1 << 20
TUPLE = "a long, r long, s long, doc long, tag long, place long, shift int"
TUPLE_COLUMNS = ["a", "r", "s", "doc", "tag", "place", "shift"]
NAMES, ROW = TUPLE_COLUMNS[:3], TUPLE_COLUMNS[3:]
#: kinds of rows that a sorted stretch of tuples gives
REPEATS, UNDECIDED, EDGE = 1, 2, 3
_BYTES = coefficients(256, 7)


class Samples:
    """In order: name, text number, and the bytes [low, high) that make the sample be one."""

    def __init__(self, name, text, low, high):
        self.name, self.text, self.low, self.high = name, text, low, high

    def __len__(self):
        return len(self.name)


class Names:
    """Two independent fingerprints of stretches of bytes: one of bytes, one of the NAME bytes from each place on."""

    def __init__(self, data: np.ndarray):
        self.bytes = anchored.Stretches(_BYTES[data])
        self.grams = anchored.Stretches(grams(data), 1)

    def first(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        return self.bytes.hashes(start, end, seed)

    def second(self, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
        return self.grams.hashes(start, np.maximum(start, end - NAME + 1), seed)


def grams(data: np.ndarray) -> np.ndarray:
    """A name of the NAME bytes from each place on."""
    padded = np.zeros(len(data) + NAME, np.uint8)
    padded[: len(data)] = data
    return mixed(np.ndarray(len(data), "<u8", buffer=padded, strides=(1,)).copy())


def every_place(data: np.ndarray, offsets: np.ndarray) -> Samples:
    """All suffixes with NAME bytes or more, named by these."""
    name = grams(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(np.arange(len(data)) + NAME <= offsets[1:][text])
    return Samples(name[at], text[at], at, at + NAME)


def local_minima(s: Samples) -> Samples:
    """Whether a sample stays depends on it and its two neighbours, which must be in the same text."""
    if len(s) < 3:
        return Samples(s.name[:0], s.text[:0], s.low[:0], s.high[:0])
    own = s.name[1:-1]
    at = np.flatnonzero((own < s.name[:-2]) & (own <= s.name[2:]) & (s.text[:-2] == s.text[2:])) + 1
    return Samples(s.name[at], s.text[at], s.low[at - 1], s.high[at + 1])


def _nearest_less(s: Samples, own: np.ndarray, width: int, step: int) -> np.ndarray:
    """For each sample of `own` the nearest one in the direction of `step` that wins over it in a string that has
    both; -1 if there is none. Equals win to the right of themselves."""
    out = np.full(len(own), -1, np.int64)
    left, k = np.arange(len(own)), step
    while len(left):
        i = own[left]
        j = i + k
        inside = (j >= 0) & (j < len(s))
        left, i, j = left[inside], i[inside], j[inside]
        reach = s.text[j] == s.text[i]
        reach &= (s.low[j] >= s.high[i] - width) if step < 0 else (s.high[j] <= s.low[i] + width)
        left, i, j = left[reach], i[reach], j[reach]
        wins = (s.name[j] <= s.name[i]) if step < 0 else (s.name[j] < s.name[i])
        out[left[wins]] = j[wins]
        left = left[~wins]
        k += step
    return out


def runs(s: Samples, own: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sample, first, last): the strings, by their starts, in which each sample of `own` is the least."""
    first, last = s.high[own] - width, s.low[own].copy()
    before, after = _nearest_less(s, own, width, -1), _nearest_less(s, own, width, 1)
    has = before >= 0
    first[has] = np.maximum(first[has], s.low[before[has]] + 1)
    has = after >= 0
    last[has] = np.minimum(last[has], s.high[after[has]] - width - 1)
    text = s.text[own]
    first, last = np.maximum(first, offsets[text]), np.minimum(last, offsets[text + 1] - width)
    some = first <= last
    return own[some], first[some], last[some]


def strings_by_sample(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH):
    """(level, low, high, text, first, last) of all runs of strings."""
    levels = [every_place(data, offsets)]
    for _ in range(LEVELS):
        levels.append(local_minima(levels[-1]))
    long = np.flatnonzero(np.diff(offsets) >= width)
    gap_first, gap_last = offsets[long], offsets[long + 1] - width
    found = []
    for number in range(LEVELS, -1, -1):
        if not len(gap_first):
            break
        s = levels[number]
        # samples that some open string may hold
        near = np.searchsorted(gap_last, s.high - width, "left")
        own = np.flatnonzero((near < len(gap_first)) & (gap_first[np.minimum(near, len(gap_first) - 1)] <= s.low))
        sample, first, last = runs(s, own, offsets, width)
        # what lies in the open stretches
        a, b = np.searchsorted(last, gap_first, "left"), np.searchsorted(first, gap_last, "right")
        n = np.maximum(0, b - a)
        gap = np.repeat(np.arange(len(n)), n)
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)
        first, last, sample = np.maximum(first[run], gap_first[gap]), np.minimum(last[run], gap_last[gap]), sample[run]
        found.append((np.full(len(sample), number), s.low[sample], s.high[sample], s.text[sample], first, last))
        ends, starts = np.sort(np.concatenate([gap_first - 1, last])), np.sort(np.concatenate([first, gap_last + 1]))
        open_ = ends + 1 <= starts - 1
        gap_first, gap_last = ends[open_] + 1, starts[open_] - 1
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tuples(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (*TUPLE_COLUMNS) of docs (doc, tag, text): shift is the sample's distance from the first string."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                data, offsets = utf8(batch.column("text"))
                level, low, high, text, first, last = strings_by_sample(data, offsets, width)
                names = Names(data)
                a = names.first(low, high, 0) ^ coefficients(LEVELS + 1, 8)[level]
                r, s = names.first(first, last + width, 1), names.second(first, last + width, 1)
                doc, tags = (batch.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc", "tag"))
                place = anchored.packed(first - offsets[text], last - first + 1)
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (a, r, s, doc, tags, place)), pa.array((low - first).astype(np.int32))], TUPLE_COLUMNS)

    return docs.mapInArrow(run, TUPLE)


SAID = "kind int, doc long, tag long, place long, shift int, pid long, a long, r long, s long, n long, differs boolean"


def _compare(batches):
    """Over sorted tuples: rows of kind REPEATS or UNDECIDED, and an EDGE for the first and the last run of equal names of
    this task, as the neighbours of those aren't known here. State: the last run and its neighbour."""
    pid = TaskContext.get().partitionId()
    names = ["kind", *ROW, "pid", *NAMES, "n", "differs"]

    def out(kind, row, key=None, n=None, differs=None):
        m = len(row[0])
        of = lambda x, t: pa.nulls(m, t) if x is None else pa.array(x, t)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
        key = [None] * len(NAMES) if key is None else key
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, kind, np.int32)), *(pa.array(x, t) for x, t in zip(row, kinds, strict=True)), pa.array(np.full(m, pid, np.int64)), *(of(x, pa.int64()) for x in key), of(n, pa.int64()), of(differs, pa.bool_())], names
        )

    # the run that may go on: (its names, its first row, rows, a of the run before it, is it the task's first)
    held = None

    def close(run, after):
        """What is said of a run's first row once the next run's a is known."""
        key, row, n, before, is_first = run
        differs = before == key[0] or after == key[0]
        if is_first:
            yield out(EDGE, row, [[x] for x in key], [n], [bool(differs)])
            return
        if n > 1:
            yield out(REPEATS, row)
        if differs:
            yield out(UNDECIDED, row)

    for batch in batches:
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in TUPLE_COLUMNS]
        keys, rows = columns[: len(NAMES)], columns[len(NAMES) :]
        a = keys[0]
        if not len(a):
            continue
        new = np.ones(len(a), bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
        if held is not None and all(x == k[0] for x, k in zip(held[0], keys, strict=True)):
            new[0] = False
        first = np.flatnonzero(new)
        later = np.flatnonzero(~new)
        if len(later):
            yield out(REPEATS, [x[later] for x in rows])
        if held is not None:
            more = int(first[0]) if len(first) else len(a)
            held = (*held[:2], held[2] + more, *held[3:])
        if not len(first):
            continue
        size = np.diff(np.append(first, len(a)))
        fa = a[first]
        if held is not None:
            yield from close(held, fa[0])
        task_first = held is None
        before = np.empty(len(fa), np.int64)
        before[1:] = fa[:-1]
        has_before = np.ones(len(fa), bool)
        if held is None:
            has_before[0], before[0] = False, 0
        else:
            before[0] = held[0][0]
        inner = slice(0, len(first) - 1)
        differs = ((before == fa) & has_before)[inner] | (fa[inner] == fa[1:])
        i = np.arange(len(first) - 1)
        if task_first and len(i):
            yield out(EDGE, [x[first[:1]] for x in rows], [k[first[:1]] for k in keys], size[:1], differs[:1])
            i, differs = i[1:], differs[1:]
        again = first[i][size[i] > 1]
        if len(again):
            yield out(REPEATS, [x[again] for x in rows])
        undecided = first[i][differs]
        if len(undecided):
            yield out(UNDECIDED, [x[undecided] for x in rows])
        k = first[-1]
        held = ([x[k] for x in keys], [x[k : k + 1] for x in rows], int(size[-1]), before[-1] if has_before[-1] else None, task_first and len(first) == 1)
    if held is not None:
        key, row, n, before, _ = held
        yield out(EDGE, row, [[x] for x in key], [n], [before is not None and bool(before == key[0])])


def sorted_and_compared(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kind, *ROW): the tuples that repeat as a whole, and those that may in part; and the stored frame they are read from."""
    unsorted = written(rows)
    said = written(unsorted.orderBy(*NAMES, "doc", "place", "tag").mapInArrow(_compare, SAID))
    dropped(unsorted)
    # two rows a task at most, so that one window over all is small whatever the corpus
    by_task = Window.orderBy("pid", *NAMES)
    edges = said.where(F.col("kind") == EDGE)
    for c in ("pid", *NAMES):
        edges = edges.withColumn(f"{c}_before", F.lag(c).over(by_task)).withColumn(f"{c}_after", F.lead(c).over(by_task))
    across = lambda side: F.coalesce((F.col(f"pid_{side}") != F.col("pid")) & (F.col(f"a_{side}") == F.col("a")), F.lit(False))
    same = lambda side: across(side) & (F.col(f"r_{side}") == F.col("r")) & (F.col(f"s_{side}") == F.col("s"))
    repeats = (F.col("n") > 1) | same("before") | same("after")
    differs = F.col("differs") | (across("before") & ~same("before")) | (across("after") & ~same("after"))
    found = (
        said.where(F.col("kind") != EDGE).select("kind", *ROW)
        .unionByName(edges.where(repeats).select(F.lit(REPEATS).alias("kind"), *ROW))
        .unionByName(edges.where(differs).select(F.lit(UNDECIDED).alias("kind"), *ROW))
    )
    return found, said


def _at_places(docs: DataFrame, said: DataFrame, make) -> DataFrame:
    """Tuples that `make` gets from the undecided places: it is given the names of a batch, and for each place
    its text's first byte, its start there, its number of strings and its shift, and returns (a, r, s, place number,
    start, number of strings, shift)."""

    def run(batches):
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                data, offsets = utf8(batch.column("text"))
                listed = batch.column("places")
                text = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
                place, shift = (listed.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("place", "shift"))
                first, count = anchored.unpacked(place)
                a, r, s, of, first, count, shift = make(Names(data), offsets[:-1][text], first, count, shift.astype(np.int64))
                doc, tags = (batch.column(c).to_numpy(zero_copy_only=False)[text[of]] for c in ("doc", "tag"))
                yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (a, r, s, doc, tags, anchored.packed(first, count))), pa.array(shift.astype(np.int32))], TUPLE_COLUMNS)

    undecided = said.where(F.col("kind") == UNDECIDED).select(*ROW).distinct()
    return anchored.with_places(docs, anchored.by_document(undecided, F.struct("place", "shift"))).mapInArrow(run, TUPLE)


def _expanded(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, 0 .. n - 1) of each of n items of each row."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def blocks(docs: DataFrame, said: DataFrame, width: int = WIDTH) -> DataFrame:
    size = max(1, min(BLOCK, width // 4))

    def make(names, base, first, count, shift):
        # distances of strings from the sample run from shift down to shift - count + 1; a block has `size` of them
        low, high = (shift - count + 1) // size, shift // size
        of, i = _expanded(high - low + 1)
        block, sample = low[of] + i, first[of] + shift[of]
        begin = np.maximum(first[of], sample - (block * size + size - 1))
        stop = np.minimum(first[of] + count[of] - 1, sample - block * size)
        core = base[of] + sample - block * size
        a = names.first(core, core - size + 1 + width, 4) ^ mixed(block.astype(np.uint64))
        r, s = (x(base[of] + begin, base[of] + stop + width, 5) for x in (names.first, names.second))
        return a, r, s, of, begin, stop - begin + 1, sample - begin

    return _at_places(docs, said, make)


def single_strings(docs: DataFrame, said: DataFrame, width: int = WIDTH) -> DataFrame:
    """One tuple for each string, of which a is a name and s another one."""

    def make(names, base, first, count, shift):
        of, i = _expanded(count)
        at = first[of] + i
        a, s = (x(base[of] + at, base[of] + at + width, 2) for x in (names.first, names.second))
        return a, np.zeros(len(at), np.int64), s, of, at, np.ones(len(at), np.int64), np.zeros(len(at), np.int64)

    return _at_places(docs, said, make)


def repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(__doc, __tag, places): the strings of each document that also start elsewhere."""
    docs, again = anchored.once(docs.select(anchored.doc_key().alias("doc"), anchored.tag().alias("tag"), "text").where(F.octet_length("text") >= width))
    whole, said = sorted_and_compared(tuples(docs, width))
    part, said_of_blocks = sorted_and_compared(blocks(docs, whole, width))
    single, said_of_strings = sorted_and_compared(single_strings(docs, part, width))
    found = whole.unionByName(part).unionByName(single).where(F.col("kind") == REPEATS).select("doc", "tag", "place")
    found = written(anchored.by_document(found.unionByName(again.withColumn("place", F.lit(anchored.WHOLE).cast("long")))))
    dropped(said, said_of_blocks, said_of_strings, again)
    return found


def dedup(docs: DataFrame, width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, spans, kept]) for each row of docs: spans are the removed
    stretches [start, end), kept the bytes left."""
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), anchored.doc_key().alias("doc"), anchored.tag().alias("tag"))
    found = repeats(docs, width)
    joined = anchored.with_places(own, found, "left").select("doc_id", "text", "places")
    schema = docs.select("doc_id").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string")
    if with_text:
        span = T.StructType().add("start", "long").add("end", "long")
        schema = schema.add("spans", T.ArrayType(span)).add("kept", "binary")

    def run(batches):
        for batch in batches:
            n_bytes, n_removed, n_spans, digest, spans, kept = [], [], [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                left = text.as_py()
                n_bytes.append(len(left))
                own = []
                if places.is_valid:
                    mask = anchored.covered(len(left), places.values.to_numpy(zero_copy_only=False), width)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
                    own = edge.reshape(-1, 2).tolist()
                    left = np.frombuffer(left, np.uint8)[~mask].tobytes()
                n_removed.append(n_bytes[-1] - len(left))
                n_spans.append(len(own))
                digest.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    spans.append([{"start": a, "end": b} for a, b in own])
                    kept.append(left)
            out = [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.array(digest, pa.string())]
            if with_text:
                out += [pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(out, schema.names)

    return joined.mapInArrow(run, schema)


def op7_suffix_array(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op7_suffix_array": op7_suffix_array}
ORACLE = {
    "op7_suffix_array": f"""
    WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
    p AS (SELECT doc_id, b, unnest(range(1, octet_length(b) - {WIDTH - 2})) AS i FROM d WHERE octet_length(b) >= {WIDTH}),
    k AS (SELECT doc_id, i - 1 AS i, md5_number(array_slice(b, i, i + {WIDTH - 1})) AS k FROM p),
    r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
    e AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WIDTH}, true) AS new FROM r),
    g AS (SELECT doc_id, i, sum(new::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM e),
    s AS (SELECT doc_id, span, min(i) AS a, max(i) + {WIDTH} AS z FROM g GROUP BY ALL),
    cut AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS begin, a AS stop FROM s
            UNION ALL SELECT doc_id, max(z), max(z), NULL FROM s GROUP BY doc_id),
    kept AS (SELECT doc_id, unhex(string_agg(hex(array_slice(b, begin + 1, coalesce(stop, octet_length(b)))), '' ORDER BY begin)) AS x FROM cut JOIN d USING (doc_id) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed FROM s GROUP BY doc_id)
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(x, b)) AS kept_sha256
    FROM d LEFT JOIN t USING (doc_id) LEFT JOIN kept USING (doc_id)
    """
}
