"""JSON documents walked once, in the task that holds them: each gives rows, which Spark then groups, joins and shuffles.

A level of all documents at a time costs a pass over what is left of them for each level, and two parses a node. A document is one cell of one
row, so no task that sees it can see less of it than all.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable, Iterable
from hashlib import blake2b
from json.encoder import encode_basestring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
#: rows of a batch that is handed back
MOST = 20_000
#: characters of documents that a task holds or hands back at once
HELD = 1 << 23
#: Spark reads JSON of up to 1,000 levels
DEEPEST = 10_000
INDEX = re.compile(r"\[([0-9]+)\]")


class Number(str):
    """A number as it is written."""


def _fraction(x: str) -> Number:
    """Spark writes what was read with an exponent as 1000.0, and that, read again, as 1000."""
    return Number("0" if x == "-0.0" else x.removesuffix(".0"))


def quoted(x: str) -> str:
    """A JSON string as Spark writes it."""
    found = encode_basestring(x)
    return re.sub(r"\\(u....|.)", lambda m: "\\u" + m[1][1:].upper() if len(m[1]) == 5 else m[0], found) if "\\u" in found else found


def text(value) -> str:
    """The JSON of a value as Spark writes it."""
    kind = type(value)
    if kind is str:
        return quoted(value)
    if kind is Number:
        return str(value)
    if kind is dict:
        return "{" + ",".join([quoted(k) + ":" + text(v) for k, v in value.items()]) + "}"
    if kind is list:
        return "[" + ",".join([text(v) for v in value]) + "]"
    return "null" if value is None else "true" if value else "false"


def leaves(value) -> list[tuple]:
    """(path, json) of the leaves that aren't null."""
    out = []

    def visit(value, path):
        kind = type(value)
        if kind is dict:
            for k, v in value.items():
                visit(v, f"{path}.{k}" if path else k)
        elif kind is list:
            for i, v in enumerate(value):
                visit(v, f"{path}[{i}]")
        elif value is not None:
            out.append((path, text(value)))

    visit(value, "")
    return out


def plain_leaves(value) -> list[tuple]:
    """(path, value) of the leaves that aren't null, as text: of a string what it holds."""
    out = []
    add = out.append

    def visit(value, path):
        kind = type(value)
        if kind is str or kind is Number:
            add((path, value))
        elif kind is dict:
            for k, v in value.items():
                visit(v, f"{path}.{k}" if path else k)
        elif kind is list:
            for i, v in enumerate(value):
                visit(v, f"{path}[{i}]")
        elif value is not None:
            add((path, text(value)))

    visit(value, "")
    return out


def project(value, mapping: dict[str, list], found: dict[str | None, tuple]) -> None:
    """Puts (places, value) of the leaves under the paths of mapping (general source: the parts of its targets between their
    places) into found; of several under one path the least stays."""

    def visit(value, path, places):
        kind = type(value)
        if kind is dict:
            for k, v in value.items():
                if "[" in k:
                    own = INDEX.findall(k)
                    if own:
                        k, below = INDEX.sub("[]", k), (*places, *map(int, own))
                        visit(v, f"{path}.{k}" if path else k, below)
                        continue
                visit(v, f"{path}.{k}" if path else k, places)
        elif kind is list:
            path += "[]"
            for i, v in enumerate(value):
                visit(v, path, (*places, i))
        elif value is not None and path in mapping:
            held = (places, value if kind is str or kind is Number else text(value))
            for parts in mapping[path]:
                if parts is None:
                    to = None
                elif len(parts) == 1:
                    to = parts[0]
                else:
                    to = parts[0]
                    for i, part in enumerate(parts[1:]):
                        to += f"[{places[i] if i < len(places) else 0}]{part}"
                if to not in found or held < found[to]:
                    found[to] = held

    visit(value, "", ())


def nodes(value, arrays: bool) -> list[tuple]:
    """(path, parent, name, at, depth, kind, json) of all nodes; with arrays=False arrays are leaves."""
    out = []

    def visit(value, path, parent, name, at, depth):
        kind = type(value)
        if kind is dict:
            named, found = "object", "{" + ",".join([quoted(k) + ":" + visit(v, f"{path}.{k}" if path else k, path, k, 0, depth + 1) for k, v in value.items()]) + "}"
        elif kind is list and arrays:
            named, found = "array", "[" + ",".join([visit(v, f"{path}[{i}]", path, "", i, depth + 1) for i, v in enumerate(value)]) + "]"
        else:
            named, found = "array" if kind is list else "null" if value is None else "value", text(value)
        out.append((path, parent, name, at, depth, named, found))
        return found

    visit(value, "", None, "", 0, 0)
    return out


def _mark(kind: str, parts: list[str]) -> str:
    return kind + blake2b(",".join(parts).encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def mark(value, ignored: tuple[str, ...], ordered: bool) -> str:
    """What a value holds, hashed: keys in any order, without those ignored, and arrays in order, or in any if not `ordered`."""
    kind = type(value)
    if kind is dict:
        return _mark("{", sorted([quoted(k) + ":" + mark(v, ignored, ordered) for k, v in value.items() if k not in ignored]))
    if kind is list:
        parts = [mark(v, ignored, ordered) for v in value]
        return _mark("[", parts if ordered else sorted(parts))
    return text(value)


def marks(value, ignored: tuple[str, ...], orders: tuple[bool, ...]) -> list[tuple]:
    """A document's marks, as 16 bytes each."""
    return [tuple(blake2b(mark(value, ignored, o).encode("utf-8", "surrogatepass"), digest_size=16).digest() for o in orders)]


def _opened(value, lists: tuple[str, ...], ignored: tuple[str, ...], ordered: bool) -> list[tuple]:
    """(block, parent, list, at, depth, object, mark) of a document that is an object, and of the objects in its lists of
    blocks, which come before what holds them."""
    out = []

    def visit(value, path, depth, name, above):
        if type(value) is dict:
            parts = []
            for k, v in value.items():
                found = visit(v, f"{path}.{k}" if path else k, depth + 1, k, path) if type(v) in (dict, list) else text(v)
                if k not in ignored:
                    parts.append(quoted(k) + ":" + found)
            return _mark("{", sorted(parts))
        parts = []
        for i, v in enumerate(value):
            if type(v) in (dict, list):
                at = f"{path}[{i}]"
                found = visit(v, at, depth + 1, "", None)
                if name in lists and type(v) is dict:
                    out.append((at, above, name, i, depth + 1, v, found))
            else:
                found = text(v)
            parts.append(found)
        return _mark("[", parts if ordered else sorted(parts))

    if type(value) is dict:
        out.append(("", None, "", 0, 0, value, visit(value, "", 0, "", None)))
    return out


def _uid(block: dict, uids: tuple[str, ...]):
    """A block's first identifier, or None."""
    return next((block[u] for u in uids if type(block.get(u, {})) not in (dict, list) and block[u] is not None and block[u] != ""), None)


def _own(block: dict, lists: tuple[str, ...]) -> str:
    """The JSON of what a block has besides its lists."""
    return "{" + ",".join([quoted(k) + ":" + text(v) for k, v in block.items() if k not in lists]) + "}"


def blocks(value, uids: tuple[str, ...], lists: tuple[str, ...], ignored: tuple[str, ...], ordered: bool) -> list[tuple]:
    """(block, parent, list, at, depth, uid, sig, own) of a document that is an object, and of the objects in its lists of
    blocks: uid is the JSON of the first identifier, own the JSON of what a block has besides its lists."""
    out = []
    for path, parent, held, at, depth, block, found in _opened(value, lists, ignored, ordered):
        uid = _uid(block, uids)
        out.append((path, parent, held, at, depth, None if uid is None else text(uid), bytes.fromhex(found[1:]), _own(block, lists)))
    return out


def merged(documents: Iterable, uids: tuple[str, ...], lists: tuple[str, ...], ignored: tuple[str, ...], ordered: bool) -> list[tuple]:
    """(first, path, n, kept, own) of the blocks of one model's documents, which come in order, as
    `operators.blocks.merged_by_signature` merges them; first is the number of a document."""
    groups, seen = {}, set()
    for no, value in enumerate(documents):
        below = {}
        for path, parent, held, at, depth, block, found in _opened(value, lists, ignored, ordered):
            below.setdefault((depth, parent), []).append((at, path, held, block, found))
        depth = 0
        level = [((), path, "", block, found) for _, path, _, block, found in below.get((0, None), ())]
        while level:
            # a block's place among all that it meets: the document's, the places from the root, its path
            level.sort(key=lambda x: x[:2])
            following = []
            for places, path, group, block, found in level:
                least = (no, places, path)
                if (own := groups.get(group)) is None:
                    own = groups[group] = [0, 0, least, _own(block, lists)]
                elif least < own[2]:
                    own[2:] = least, _own(block, lists)
                own[0] += 1
                if (mark := (depth, group, found)) in seen:
                    continue
                seen.add(mark)
                own[1] += 1
                for at, inner, held, v, its in below.get((depth + 2, path), ()):
                    uid = _uid(v, uids)
                    uid = "unknown" if uid is None else uid if type(uid) is str else text(uid)
                    following.append(((*places, at), inner, f"{group}/{held}:{uid}" if group else f"{held}:{uid}", v, its))
            level, depth = following, depth + 2
    return [(least[0], path, n, kept, own) for path, (n, kept, least, own) in groups.items()]


def rows(frame: DataFrame, keys: list[str], column: str, make: Callable, columns: str) -> DataFrame:
    """(keys, columns): the rows that make(document) gives of each JSON document. Text that isn't JSON gives none. Documents are
    dealt out by their keys first: those of a small table come from one file and would all be opened by one task."""
    names = [c.split()[0] for c in columns.split(", ")]
    types = [TYPES[c.split()[1]] for c in columns.split(", ")]
    read = frame.repartition(*keys).select(*keys, F.to_json(F.try_parse_json(column)).alias("__json")).where("__json IS NOT NULL")

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        decode = json.JSONDecoder(parse_int=Number, parse_float=_fraction).decode

        def batch_of(batch, at, out):
            own = [batch.column(k).take(pa.array(at, pa.int64())) for k in keys]
            return pa.RecordBatch.from_arrays([*own, *[pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]], [*keys, *names])

        for batch in batches:
            at, out = [], []
            for i, document in enumerate(batch.column("__json")):
                made = make(decode(document.as_py()))
                for start in range(0, len(made), MOST):
                    part = made[start : start + MOST]
                    out += part
                    at += [i] * len(part)
                    if len(out) >= MOST:
                        yield batch_of(batch, at, out)
                        at, out = [], []
            if out:
                yield batch_of(batch, at, out)

    schema = StructType([*[frame.schema[k] for k in keys], *StructType.fromDDL(columns)])
    return read.mapInArrow(run, schema)


def by_ranges(frame: DataFrame, group: str, order: str, column: str, make: Callable, columns: str) -> DataFrame:
    """(group, order, columns, __json): the rows that make(documents) gives of all JSON documents of a group in order, where one
    task holds them all; the first value that it gives for a row is the number of the document whose order the row has. group is never
    null.

    Documents are dealt out by ranges of (group, order), so a group of any length is spread over tasks. Those of the
    groups at both ends of a task, which may go on in another one, and of groups of over HELD characters come back as they are, in
    __json, for the caller to deal with; a task has no more than HELD in hand.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    types = [TYPES[c.split()[1]] for c in columns.split(", ")]
    dealt = frame.select(group, order, column).repartitionByRange(group, order).sortWithinPartitions(group, order)
    read = dealt.select(group, order, F.to_json(F.try_parse_json(column)).alias("__json"))

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        decode = json.JSONDecoder(parse_int=Number, parse_float=_fraction).decode
        now, whole, held, size = None, False, [], 0
        out, waiting, own_types = [], 0, None

        def batch_of(out):
            cells = zip(*out, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (*own_types, *types, pa.string()), strict=True)], [group, order, *names, "__json"])

        def as_they_are(documents):
            return [(now, at, *[None] * len(names), document) for at, document in documents]

        for batch in batches:
            own_types = [batch.schema.field(k).type for k in (group, order)]
            for own, at, document in zip(batch.column(group).to_pylist(), batch.column(order).to_pylist(), batch.column("__json"), strict=True):
                if own != now:
                    if whole:
                        out += [(now, held[no][0], *row, None) for no, *row in make(decode(d) for _, d in held)]
                        waiting += size
                    # the first group of a task may have begun in another one
                    now, whole, held, size = own, now is not None, [], 0
                if (document := document.as_py()) is not None:
                    size += len(document)
                    held.append((at, document))
                    if not whole or size > HELD:
                        out += as_they_are(held)
                        waiting += size
                        whole, held, size = False, [], 0
                if len(out) >= MOST or waiting > HELD:
                    yield batch_of(out)
                    out, waiting = [], 0
        # and the last may go on in another one
        out += as_they_are(held)
        if out:
            yield batch_of(out)

    schema = StructType([frame.schema[group], frame.schema[order], *StructType.fromDDL(f"{columns}, __json string")])
    return read.mapInArrow(run, schema)


def projected(frame: DataFrame, key: str, column: str, pairs: dict[str, list]) -> DataFrame:
    """(key, path, value) of the leaves of JSON documents under the paths that pairs gives them, as `project` does, one for each
    key and path. All documents of a key are in one task, which waits for as many as there are."""
    same = Window.partitionBy(key)
    read = frame.select(key, F.to_json(F.try_parse_json(column)).alias("__json")).where("__json IS NOT NULL").select(key, "__json", F.count("*").over(same).alias("__n"))
    shared = frame.sparkSession.sparkContext.broadcast(pairs)

    def run(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
        decode = json.JSONDecoder(parse_int=Number, parse_float=_fraction).decode
        mapping, open_keys = shared.value, {}

        def batch_of(batch, at, paths, values):
            own = batch.column(key).take(pa.array(at, pa.int64()))
            return pa.RecordBatch.from_arrays([own, pa.array(paths, pa.string()), pa.array(values, pa.string())], [key, "path", "value"])

        for batch in batches:
            at, paths, values = [], [], []
            for i, (document, n) in enumerate(zip(batch.column("__json").to_pylist(), batch.column("__n").to_pylist(), strict=True)):
                found = {}
                if n > 1:
                    own = batch.column(key)[i].as_py()
                    left, found = open_keys.pop(own, (n, found))
                    if left > 1:
                        open_keys[own] = (left - 1, found)
                project(decode(document), mapping, found)
                if n > 1 and left > 1:
                    continue
                paths += found
                values += [v for _, v in found.values()]
                at += [i] * len(found)
                if len(at) >= MOST:
                    yield batch_of(batch, at, paths, values)
                    at, paths, values = [], [], []
            if at:
                yield batch_of(batch, at, paths, values)

    schema = StructType([frame.schema[key], *StructType.fromDDL("path string, value string")])
    return read.mapInArrow(run, schema)


def plain(value: Column) -> Column:
    """The text of a JSON value: of a string what it holds. Only strings with escapes, and numbers, are parsed."""
    bare = F.startswith(value, F.lit('"')) & ~F.contains(value, F.lit("\\"))
    return F.when(bare, F.substr(value, F.lit(2), F.length(value) - 2)).otherwise(F.try_variant_get(F.parse_json(F.when(~bare, value)), "$", "string"))
