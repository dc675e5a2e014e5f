"""Nested content in rows: a row for each leaf or block, its place in the tree being a path.

What a recursion over one document does at each level is a group-by or a join on the path here, for all documents at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import json_trees

INDEX = r"\[(\d+)\]"
#: pairs of paths of a mapping that every task may hold
PAIRS = 10_000


def leaves(rows: DataFrame, key: str, column: str) -> DataFrame:
    """(key, path, value) of each leaf of a JSON column: a.b[0].c, and its value as text; empty objects and arrays and nulls
    have none. A document is opened in one go, in the task that holds it."""
    return json_trees.rows(rows, [key], column, json_trees.plain_leaves, "path string, value string")


def general(path: Column) -> Column:
    """A path with its places left open: a[].b[]."""
    return F.regexp_replace(path, INDEX, "[]")


def projected(found: DataFrame, key: str, mapping: DataFrame) -> DataFrame:
    """(key, path, value) of leaves (key, path, value) under the paths that mapping (source, target), both general, gives
    them: the places of the source go to those of the target in order, and what the target has no place for is left out,
    of which the first by place counts. A source may go to several targets."""
    rows = found.withColumn("source", general(F.col("path"))).join(mapping, "source")
    places = F.transform(F.regexp_extract_all("path", F.lit(INDEX), 1), lambda x: x.cast("int"))
    parts = F.split("target", r"\[\]")
    filled = F.transform(parts, lambda part, i: F.concat(part, F.when(i < F.size(parts) - 1, F.concat(F.lit("["), F.coalesce(F.get("places", i), F.lit(0)).cast("string"), F.lit("]"))).otherwise("")))
    made = rows.withColumn("places", places).select(key, F.array_join(filled, "").alias("path"), "places", "value")
    return made.groupBy(key, "path").agg(F.min_by("value", F.struct("places", "value")).alias("value"))


def projected_documents(docs: DataFrame, key: str, column: str, mapping: DataFrame, most: int = PAIRS) -> DataFrame:
    """`projected` of the leaves of a JSON column. What meets under one path comes from documents of one key, so with a mapping
    of up to `most` pairs it is settled where they are opened; leaves are neither joined nor grouped. A longer mapping is
    joined."""
    pairs = mapping.select("source", "target").where("source IS NOT NULL").distinct().limit(most + 1).collect()
    if len(pairs) > most:
        return projected(leaves(docs, key, column), key, mapping)
    to: dict[str, list] = {}
    for source, target in pairs:
        to.setdefault(source, []).append(None if target is None else target.split("[]"))
    return json_trees.projected(docs, key, column, to)


def merged_blocks(blocks: DataFrame, model: str, path: str, order: str, payload: str | None = None) -> DataFrame:
    """(model, path, n, first, payload) of blocks whose path is the array of identifiers from the root: at each level blocks of
    one identifier are one, so blocks with equal paths are, and what is below them meets again. `n` is how many they were,
    `first` the order of the first, whose payload stays and by which siblings are sorted."""
    kept = [F.min_by(payload, order).alias(payload)] if payload else []
    return blocks.groupBy(model, path).agg(F.count("*").alias("n"), F.min(order).alias("first"), *kept)


def merged_settings(blocks: DataFrame, model: str, path: str, order: str, settings: str) -> DataFrame:
    """(model, path, settings): the union of the maps of blocks with equal paths; of a key the first value that isn't null."""
    each = blocks.select(model, path, order, F.explode(settings).alias("k", "v")).where("v IS NOT NULL").groupBy(model, path, "k").agg(F.min_by("v", order).alias("v"))
    found = each.groupBy(model, path).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias(settings))
    return blocks.select(model, path).distinct().join(found, [model, path], "left")
