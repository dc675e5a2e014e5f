"""Trees of JSON content compared and merged for all documents at once.

Every object, array and value of every document is a row that knows its parent. Signatures go from the leaves up and merges
from the root down, each with one group-by and one join a level, however many documents there are; nothing is collected:
what a node's children add up to is a sum of hashes, which Spark combines before it shuffles. Blocks of a model whose
documents one task has are merged in that task.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import json_trees
from marlstream.operators.windows import numbered
from marlstream.session import dropped, stored

#: what tells two occurrences of a block apart without making them different
PLACES = ("id", "position", "index")
#: lists of a block that hold blocks
LISTS = ("blocks", "schema")
#: a block's identifier, the first that it has
UIDS = ("fieldUid", "uid")


def nodes(rows: DataFrame, keys: list[str], column: str, arrays: bool = True) -> DataFrame:
    """(keys, path, parent, name, at, depth, kind, json) of all nodes of a JSON column. kind is object, array, value or
    null; name is the key in an object, at the place in an array. With arrays=False arrays are leaves. Text that isn't JSON
    has no nodes. A document is opened in one go, in the task that
    holds it. Stored."""
    opened = partial(json_trees.nodes, arrays=arrays)
    return stored(json_trees.rows(rows, keys, column, opened, "path string, parent string, name string, at int, depth int, kind string, json string"))


def _key(column: str) -> Column:
    """A text for each value, of which null is one; it is never null itself."""
    return F.when(F.col(column).isNull(), "-").otherwise(F.concat(F.lit("+"), F.col(column).cast("string")))


def _value(key: str, docs: DataFrame, column: str) -> Column:
    return F.when(F.startswith(key, F.lit("+")), F.substring(key, 2, (1 << 31) - 1)).cast(docs.schema[column].dataType)


def _added(*parts) -> list[Column]:
    """Two sums of hashes of rows, with a range that no group exceeds."""
    return [F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)")).alias(f"sum{seed}") for seed in (1, 2)]


def signatures(tree: DataFrame, keys: list[str], ignored: tuple[str, ...] = PLACES, ordered: bool = True) -> DataFrame:
    """tree with sig1 and sig2, two independent hashes of what a node holds: keys in any order, without those ignored, and
    arrays in order, or in any if not `ordered`."""
    last = tree.agg(F.max("depth")).first()[0]
    if last is None:
        return tree.withColumns({"sig1": F.lit(0).cast("long"), "sig2": F.lit(0).cast("long")})
    place = F.when((F.col("name") == "") & F.lit(ordered), F.col("at")).otherwise(0)
    done, below = [], None
    for depth in range(last, -1, -1):
        now = tree.where(F.col("depth") == depth)
        if below is None:
            now = now.withColumns({"sum1": F.lit(None).cast("decimal(38,0)"), "sum2": F.lit(None).cast("decimal(38,0)")})
        else:
            children = below.where(~F.col("name").isin(*ignored) if ignored else F.lit(True)).select(*keys, F.col("parent").alias("__of"), "name", place.alias("place"), "sig1", "sig2")
            sums = children.groupBy(*keys, "__of").agg(*_added("name", "place", "sig1", "sig2"))
            now = now.join(sums.withColumnRenamed("__of", "path"), [*keys, "path"], "left")
        value = F.when(F.col("kind").isin("value", "null"), F.col("json"))
        sig = [F.xxhash64(F.lit(seed), "kind", value, "sum1", "sum2").alias(f"sig{seed}") for seed in (1, 2)]
        below = stored(now.select(*tree.columns, *sig))
        done.append(below)
    return reduce(DataFrame.unionByName, done)


def document_signatures(docs: DataFrame, keys: list[str], column: str, ignored: tuple[str, ...] = PLACES, orders: dict[str, bool] | None = None) -> DataFrame:
    """(keys, a column for each of orders): what whole documents hold, as `signatures` compares it, with arrays in order or in
    any; each document is read once. The hashes have 128 bits."""
    orders = orders or {"sig": True}
    made = partial(json_trees.marks, ignored=ignored, orders=tuple(orders.values()))
    return json_trees.rows(docs, keys, column, made, ", ".join(f"{name} binary" for name in orders))


def merged_by_signature(docs: DataFrame, model: str, order: str, column: str, uids: tuple[str, ...] = UIDS, lists: tuple[str, ...] = LISTS, ordered: bool = True) -> DataFrame:
    """(model, path, n, kept, first, attributes): the blocks of all documents of a model merged into one tree.

    Siblings of one uid in one list become one block, at every level: path is the lists and uids from the root. What such
    blocks hold in their lists comes together; of those with one signature only the first by (order, place) goes on, the
    others with all below them are left out. n is how many blocks met, kept how many of them went on, first the order of
    the first and attributes what it has besides its lists.

    `order` is unique in a model, null comes first. Documents of a null model are one model; blocks without an identifier are `unknown`. Documents
    are dealt out by ranges of model and order. A model that one task has whole is merged there, so that its blocks are
    never written or shuffled; the models that are cut by the ranges, two a task at most, and very large ones are merged a level at a
    time by many tasks.
    """
    rows = docs.select(_key(model).alias("__model"), F.col(order).alias("__order"), F.col(column).alias("__text"))
    made = partial(json_trees.merged, uids=uids, lists=lists, ignored=PLACES, ordered=ordered)
    passed = stored(json_trees.by_ranges(rows, "__model", "__order", "__text", made, "path string, n bigint, kept bigint, attributes string"))
    # a null order joins inside a struct
    cut = passed.where("__json IS NOT NULL").select("__model", F.struct("__order").alias("__order"), F.col("__json").alias("__text"))
    by_levels = _merged_by_levels(cut, uids, lists, ordered).withColumn("__order", F.col("__order.__order"))
    found = passed.where("__json IS NULL").drop("__json").unionByName(by_levels)
    return found.select(_value("__model", docs, model).alias(model), "path", "n", "kept", F.col("__order").alias("first"), "attributes")


def _merged_by_levels(rows: DataFrame, uids: tuple[str, ...], lists: tuple[str, ...], ordered: bool) -> DataFrame:
    """(__model, __order, path, n, kept, attributes) of (__model, __order, __text): `merged_by_signature` with one group-by and
    one join a level for all models at once. Stored."""
    keys = ["__model", "__order"]
    made = partial(json_trees.blocks, uids=uids, lists=lists, ignored=PLACES, ordered=ordered)
    found = json_trees.rows(rows, keys, "__text", made, "block string, parent string, list string, at int, depth int, uid string, sig binary, own string")
    every = stored(found.withColumn("uid", F.coalesce(json_trees.plain(F.col("uid")), F.lit("unknown"))))
    last = every.agg(F.max("depth")).first()[0]
    # a block's place among all that it meets: the document's order and the places from the root
    level = every.where("depth = 0").select(*keys, "block", "uid", F.lit("").alias("group"), F.array().cast("array<int>").alias("places"), "sig", F.lit(True).alias("kept"))
    done = []
    for depth in range(0, (last or 0) + 2, 2):
        here = F.struct("__order", "places", "block")
        # of the blocks that meet, those with one signature go on once
        firsts = level.groupBy("__model", "group", "sig").agg(F.min(here).alias("least"))
        now = stored(level.join(firsts, ["__model", "group", "sig"]).select(*keys, "block", "group", "places", (here == F.col("least")).alias("kept")))
        done.append(now)
        if depth >= (last or 0):
            break
        up = now.where("kept").select(*keys, F.col("block").alias("parent"), F.col("group").alias("__above"), F.col("places").alias("__places"))
        below = every.where(F.col("depth") == depth + 2).join(up, [*keys, "parent"])
        level = below.select(*keys, "block", "uid", F.concat_ws("/", F.nullif("__above", F.lit("")), F.concat("list", F.lit(":"), "uid")).alias("group"), F.array_append("__places", F.col("at")).alias("places"), "sig")
    met = reduce(DataFrame.unionByName, done)
    first = F.min(F.struct("__order", "places", "block"))
    groups = met.groupBy("__model", "group").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), first.alias("first"))
    base = groups.select("__model", "group", "n", "kept", F.col("first.__order").alias("__order"), F.col("first.block").alias("block")).join(every.select(*keys, "block", "own"), [*keys, "block"])
    result = stored(base.select(*keys, F.col("group").alias("path"), "n", "kept", F.col("own").alias("attributes")))
    dropped(every, *done)
    return result


def deep_merged(docs: DataFrame, group: str, order: str, column: str, concatenated: tuple[str, ...] = ("blocks",)) -> DataFrame:
    """(group, path, value) of the leaves of all JSON objects of a group merged in order, as a fold over them would.

    Objects merge key by key; of values the first that isn't null stays; arrays become their union, elements equal as
    JSON being one, in the order of their first places, and those at the paths `concatenated` are put one behind another. An
    object or array takes the place of a value, and of two kinds the later takes the place of the earlier with all it
    held; a value never takes the place of an object or array. The value of an array's element is its JSON, an element's path
    ends in its place [n]; empty objects and arrays have no rows. Each level is one group-by; an element's place is found by a
    range sort of all elements, so an array of any length is ranked by many tasks. `order` is unique in a group.
    """
    keys = ["__group", "__order"]
    rows = docs.select(_key(group).alias("__group"), F.col(order).alias("__order"), F.col(column).alias("__text")).repartition(*keys)
    rows = rows.select(*keys, F.to_json(F.try_parse_json("__text")).alias("json")).where("json IS NOT NULL")
    level = rows.select(*keys, F.lit("").alias("path"), "json")
    values, elements, kept = [], [], []
    while True:
        kind = F.when(F.startswith("json", F.lit("{")), "object").when(F.startswith("json", F.lit("[")), "array").when(F.col("json") == "null", "null").otherwise("value")
        now = stored(level.withColumn("kind", kind).where("kind <> 'null'"))
        kept.append(now)
        if now.isEmpty():
            break
        last = {k: F.max(F.when(F.col("kind") == k, F.col("__order"))).alias(f"last_{k}") for k in ("object", "array")}
        first = F.min(F.when(F.col("kind") == "value", F.col("__order"))).alias("first_value")
        of = now.groupBy("__group", "path").agg(*last.values(), first)
        to_array = F.coalesce(F.col("last_array") > F.col("last_object"), F.col("last_array").isNotNull())
        decided = of.select(
            "__group", "path",
            F.when(F.col("last_array").isNull() & F.col("last_object").isNull(), "value").when(to_array, "array").otherwise("object").alias("kind"),
            # what came before the last of the other kind is lost
            F.when(to_array, F.col("last_object")).otherwise(F.col("last_array")).alias("after"), "first_value",
        )
        joined = now.join(decided, ["__group", "path", "kind"])
        alive = stored(joined.where(F.when(F.col("kind") == "value", F.col("__order") == F.col("first_value")).otherwise(F.col("after").isNull() | (F.col("__order") > F.col("after")))).select(*keys, "path", "kind", "json"))
        kept.append(alive)
        v = F.parse_json("json")
        values.append(alive.where("kind = 'value'").select("__group", "path", F.variant_get(v, "$", "string").alias("value")))
        elements.append(alive.where("kind = 'array'").select(*keys, "path", F.posexplode(F.variant_get(v, "$", "array<variant>")).alias("at", "v")).select(*keys, "path", "at", F.to_json("v").alias("value")))
        opened = alive.where("kind = 'object'").select(*keys, F.col("path").alias("above"), F.explode(F.variant_get(v, "$", "map<string,variant>")).alias("name", "v"))
        level = opened.select(*keys, F.when(F.col("above") == "", F.col("name")).otherwise(F.concat_ws(".", "above", "name")).alias("path"), F.to_json("v").alias("json"))
    if not values:
        return now.select(_value("__group", docs, group).alias(group), "path", F.col("json").alias("value"))
    each = reduce(DataFrame.unionByName, elements)
    in_a_row = F.col("path").isin(*concatenated)
    place = F.struct("__order", "at")
    union = each.where(~in_a_row).groupBy("__group", "path", "value").agg(F.min(place).alias("first"))
    union = union.unionByName(each.where(in_a_row).select("__group", "path", "value", place.alias("first")))
    ranked = numbered(union, ["__group", "path", "first"], "n")
    ends = ranked.groupBy("__group", "path").agg(F.min("n").alias("least"))
    placed = ranked.join(ends, ["__group", "path"]).select("__group", F.concat("path", F.lit("["), F.col("n") - F.col("least"), F.lit("]")).alias("path"), "value")
    result = stored(placed.unionByName(reduce(DataFrame.unionByName, values)).select(_value("__group", docs, group).alias(group), "path", "value"))
    dropped(*kept)
    return result
