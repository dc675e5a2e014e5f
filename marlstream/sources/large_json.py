"""One large JSON document read by many tasks.

A document {"section": [element, ...], ...} is read as text with } as the line separator, so Spark splits it by byte ranges
(of spark.sql.files.maxPartitionBytes) and every piece belongs to one range. What a range needs to know of those before it
comes from sums over ranges, a row each:

1. Quotes that aren't escaped, modulo two, say whether a range starts inside a string. Brackets outside strings, counted
   for either case, then say at which depth it starts.
2. With both known, each range says which section it leaves open, and the last one that did is carried on.
3. Each range gives its elements. An element that crosses ranges comes in parts, which are joined in order; no more
   than one is open at the end of a range, so these groups are few and small.

The file is read three times and only parts of elements that cross ranges are shuffled. Compressed files are one range.
Defined cases: a section that isn't an array is one element; an empty array has none; of repeated sections all elements
come, in order; an empty file has none. A section's name must not hold a }. The document must be valid JSON.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstream.session import stored


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): a file is known by a hash, as its path would go with each of its pieces."""
    return spark.read.option("lineSep", "}").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


#: what says where a document's parts begin and end, and by how much it changes the depth
_TOLD = np.zeros(256, bool)
_TOLD[list(b'"{}[]:,')] = True
_CHANGE = np.zeros(256, np.int8)
_CHANGE[list(b"{[")], _CHANGE[list(b"}]")] = 1, -1
QUOTE, COLON, COMMA, SQUARE = b'":,['


def _escaped(data: np.ndarray, quotes: np.ndarray, most: int = 32) -> np.ndarray:
    """Which quotes stand behind an odd number of backslashes. Few stand behind one, of which those behind many are looked up
    in a pass over all bytes."""
    escaped = np.zeros(len(quotes), bool)
    behind = np.flatnonzero((quotes > 0) & (data[quotes - 1] == 92))
    for n in range(1, most):
        escaped[behind] = n % 2 == 1
        before = quotes[behind] - n - 1
        behind = behind[(before >= 0) & (data[before] == 92)]
        if not len(behind):
            return escaped
    at = np.arange(len(data))
    last = np.maximum.accumulate(np.where(data != 92, at, -1))
    escaped[behind] = (quotes[behind] - 1 - last[quotes[behind] - 1]) % 2 == 1
    return escaped


def _structure(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bytes that tell: their places, which are quotes that aren't escaped, and how many such there are up to each,
    modulo two. Bytes of strings are among them."""
    at = np.flatnonzero(_TOLD[data])
    quote = data[at] == QUOTE
    places = np.flatnonzero(quote)
    quote[places] = ~_escaped(data, at[places])
    return at, quote, np.bitwise_xor.accumulate(quote.view(np.uint8)) if len(at) else np.zeros(0, np.uint8)


def _by_range(batches, begin, step, end):
    """begin(row) at the first piece of a range, step(state, bytes) for what a batch has of it, separators included, and
    end(range, state); what step(...) and end(...) yield is passed on as (range, item)."""
    now, state = None, None
    for batch in batches:
        files, starts = batch.column("file").to_numpy(), batch.column("start").to_numpy()
        edges = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1).tolist()] if len(files) else []
        for a, b in zip(edges, [*edges[1:], len(files)], strict=True):
            if (int(files[a]), int(starts[a])) != now:
                if now is not None:
                    yield from ((now, x) for x in end(state))
                now = (int(files[a]), int(starts[a]))
                state = begin({c: batch.column(c)[a].as_py() for c in batch.schema.names if c != "value"})
            values = batch.column("value").slice(a, b - a)
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), values), "}")[0].as_buffer()
            yield from ((now, x) for x in step(state, np.append(np.frombuffer(text, np.uint8), np.uint8(125))))
    if now is not None:
        yield from ((now, x) for x in end(state))


def _sums(batches):
    def step(total, data):
        at, quote, odd = _structure(data)
        change = np.where(quote, 0, _CHANGE[data[at]]).astype(np.int64)
        within = int(change[odd == 1].sum())
        net = (int(change.sum()) - within, within)
        for case in (0, 1):
            total[1 + case] += net[case ^ total[0]]
        total[0] ^= int(odd[-1]) if len(odd) else 0
        return ()

    for (file, start), (quotes, outside, inside) in _by_range(batches, lambda _: [0, 0, 0], step, lambda total: [total]):
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "quotes": [quotes], "outside": [outside], "inside": [inside]})


class _Reader:
    """Walks through a range. kind: None between sections, value from a name's colon on, array or object within a section,
    unknown where that isn't told yet, ended behind a section."""

    def __init__(self, row: dict, outline: bool = False):
        self.outline = outline
        self.inside, self.depth = row["in_string"], row["depth"]
        self.section = row.get("section")
        self.kind = None if self.depth == 0 else row.get("kind") or "unknown" if self.depth > 1 else "value" if self.inside else "ended"
        self.head = self.kind in ("array", "object", "value")
        self.part: list[bytes] = []

    def _ended(self, text: bytes):
        text = b"".join([*self.part, text])
        head, self.head, self.part = self.head, False, []
        if head or text.strip():
            yield self.section, text, head, True

    def read(self, data: np.ndarray):
        """(section, text, whether it goes on from an earlier range, whether it ends) of elements that end here. An outline has
        no elements of arrays."""
        at_all, quote, odd = _structure(data)
        free = ~quote & (odd == self.inside)
        places = at_all[free]
        signs = data[places]
        change = _CHANGE[signs]
        depth = self.depth + np.cumsum(change, dtype=np.int64)
        colon, comma = (signs == COLON) & (depth == 1), (signs == COMMA) & (depth <= (1 if self.outline else 2))
        here = np.flatnonzero(colon | comma | ((change == 1) & (depth <= 2)) | ((change == -1) & (depth <= 1)))
        raw, at = data.tobytes(), 0
        for e, sign, d, way in zip(places[here].tolist(), signs[here].tolist(), depth[here].tolist(), change[here].tolist(), strict=True):
            if sign == COLON:
                name = raw[at:e].strip()
                if self.kind is not None or not name.startswith(b'"'):
                    raise ValueError("a section's name holds a }, or this isn't JSON")
                self.section, self.kind, at = json.loads(name), "value", e + 1
            elif way == 1 and d == 1:
                at = e + 1
            elif way == 1:
                # a section's bracket: an array's elements come one by one, an object is one
                self.kind, at = ("array", e + 1) if sign == SQUARE else ("object", e)
            elif d == 2:
                if self.kind == "array":
                    yield from self._ended(raw[at:e])
                    at = e + 1
            elif way == -1 and d == 1:
                if self.kind in ("array", "object"):
                    yield from self._ended(raw[at : e + (self.kind == "object")])
                self.kind, at = "ended", e + 1
            else:
                if self.kind == "value":
                    yield from self._ended(raw[at:e])
                self.kind, at = None, e + 1
        if self.kind in ("array", "object", "value") and not self.outline:
            self.part.append(raw[at:])
        self.inside ^= int(odd[-1]) if len(odd) else 0
        self.depth = int(depth[-1]) if len(depth) else self.depth

    def rest(self):
        """What is open at the end of a range."""
        text = b"".join(self.part)
        if self.kind in ("array", "object", "value") and (self.head or text.strip()):
            yield self.section, text, self.head, False


def _sections(batches):
    def walk(reader, data):
        for _ in reader.read(data):
            pass
        return ()

    end = lambda reader: [(reader.section, reader.kind)] if reader.section is not None and reader.kind in ("array", "object", "value") else []
    for (file, start), (section, kind) in _by_range(batches, lambda row: _Reader(row, True), walk, end):
        yield pa.RecordBatch.from_pydict({"file": [file], "start": [start], "section": [section], "kind": [kind]})


def _elements(batches):
    for (file, start), (section, text, head, ended) in _by_range(batches, _Reader, lambda reader, data: reader.read(data), lambda reader: reader.rest()):
        yield file, start, section, text.decode(), head, ended


def _element_batches(batches, most: int = 1000):
    names = {"file": pa.int64(), "start": pa.int64(), "seq": pa.int64(), "section": pa.string(), "text": pa.string(), "head": pa.bool_(), "ended": pa.bool_()}
    rows: list[tuple] = []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), names.values(), strict=True)], list(names))

    for seq, (file, start, *found) in enumerate(_elements(batches)):
        rows.append((file, start, seq, *found))
        if len(rows) == most:
            yield batch()
            rows = []
    if rows:
        yield batch()


def elements(spark: SparkSession, path: str) -> DataFrame:
    """(section, pos, json) of all elements of the sections of a document, or of each of several in a folder. Stored."""
    pieces = _pieces(spark, path)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    sums = stored(pieces.mapInArrow(_sums, "file long, start long, quotes long, outside long, inside long"))
    states = sums.withColumn("in_string", (none("quotes") % 2).cast("int")).withColumn("change", F.when(F.col("in_string") == 1, F.col("inside")).otherwise(F.col("outside")))
    states = stored(states.select("file", "start", "in_string", none("change").cast("int").alias("depth")))
    # a row for each range
    told = pieces.join(F.broadcast(states), ["file", "start"])
    left_open = told.mapInArrow(_sections, "file long, start long, section string, kind string")
    ended = states.join(left_open, ["file", "start"], "left").withColumn("open", F.when(F.col("section").isNotNull(), F.struct("section", "kind")))
    carried = stored(ended.select("file", "start", "in_string", "depth", F.last("open", ignorenulls=True).over(earlier).alias("open")).select("file", "start", "in_string", "depth", "open.section", "open.kind"))
    found = stored(pieces.join(F.broadcast(carried), ["file", "start"]).mapInArrow(_element_batches, "file long, start long, seq long, section string, text string, head boolean, ended boolean"))
    # places: what a section has in the ranges before, and in this one
    first = found.where("NOT head").groupBy("file", "section", "start").agg(F.count("*").alias("n"), F.min("seq").alias("least"))
    before = Window.partitionBy("file", "section").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    places = first.select("file", "section", "start", "least", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    placed = found.where("NOT head").join(F.broadcast(places), ["file", "section", "start"]).select("file", "start", "seq", "section", "text", "ended", (F.col("before") + F.col("seq") - F.col("least")).alias("pos"))
    whole = placed.where("ended").select("section", "pos", F.trim("text", F.lit(" \t\r\n")).alias("json"))
    parts = found.where("head OR NOT ended").select("file", "start", "seq", "head", "text")
    upto = Window.partitionBy("file").orderBy("start", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("of", F.last(F.when(~F.col("head"), F.col("start")), ignorenulls=True).over(upto))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "text"))), lambda x: x["text"])
    joined = parts.groupBy("file", F.col("of").alias("start")).agg(F.array_join(texts, "").alias("whole"))
    crossing = placed.where("NOT ended").join(joined, ["file", "start"]).select("section", "pos", F.trim("whole", F.lit(" \t\r\n")).alias("json"))
    return whole.unionByName(crossing)


def sections(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """For each section asked for its elements parsed by a schema: (pos, fields); a missing section has no rows."""
    every = elements(spark, path)
    return {name: every.where(F.col("section") == name).select("pos", F.from_json("json", schema).alias("x")).select("pos", "x.*") for name, schema in schemas.items()}
