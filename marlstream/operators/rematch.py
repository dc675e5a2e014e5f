"""Mapped fields matched again with a destination that has changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstream.operators.windows import numbered
from marlstream.session import dropped, stored

#: rounds of what has to be equal: nothing has changed, it was moved or its group renamed, it was renamed in its place
ROUNDS = (("uid", "path"), ("uid",), ("path",))

#: rows of a type on both sides together that one task settles
MOST = 1_000_000
#: rows on average of a task that settles types
ROWS = 250_000


def _ranked(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """rows with their rank among those of a group. The whole table is sorted by ranges, so that a group of any size is
    ranked by many tasks."""
    placed = numbered(rows, [*group, order], "__n")
    first = placed.groupBy(*group).agg(F.min("__n").alias("__first"))
    return placed.join(first, group).withColumn("__rank", F.col("__n") - F.col("__first")).drop("__n", "__first")


def _by_ranges(mapped: DataFrame, destination: DataFrame, rounds: tuple[tuple[str, ...], ...]) -> DataFrame:
    """(type, field, round, place, uid, path, field_type) of stored sides without null types: each round ranks both by range sorts
    and joins what is left of them. Stored."""
    left, free = mapped, destination
    gone, found = [], []
    for number, keys in enumerate(rounds):
        group = ["type", *keys]
        there = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        own = _ranked(left.where(there), group, "field")
        other = _ranked(free.where(there), group, "place").select(*group, "__rank", "place", *[F.col(c).alias(f"to_{c}") for c in ("uid", "path", "field_type")])
        hit = stored(own.join(other, [*group, "__rank"]).select("type", "field", F.lit(number).alias("round"), "place", F.col("to_uid").alias("uid"), F.col("to_path").alias("path"), F.col("to_field_type").alias("field_type")))
        found.append(hit)
        left = stored(left.join(hit.select("type", "field"), ["type", "field"], "left_anti"))
        free = stored(free.join(hit.select("type", "place"), ["type", "place"], "left_anti"))
        gone += [left, free]
    result = stored(reduce(DataFrame.unionByName, [*found, left.select("type", "field", *_nothing(destination))]))
    dropped(*gone, *found)
    return result


def _nothing(destination: DataFrame) -> list[Column]:
    return [F.lit(None).cast(kind).alias(c) for c, kind in (("round", "int"), ("place", destination.schema["place"].dataType), ("uid", "string"), ("path", "string"), ("field_type", "string"))]


def _kind(rows: DataFrame) -> StructType:
    return rows.select("place", "uid", "path", "field_type").schema


def _within_types(rows: DataFrame, rounds: tuple[tuple[str, ...], ...]) -> DataFrame:
    """The same of both sides in one frame: they are dealt out by type once, to tasks that don't grow with the input, and all rounds
    are windows within that."""
    tasks = max(rows.count() // ROWS + 1, rows.sparkSession.sparkContext.defaultParallelism)
    now = rows.repartition(tasks, "type").withColumns({"__round": F.lit(None).cast("int"), "__to": F.lit(None).cast(_kind(rows))})
    for number, keys in enumerate(rounds):
        is_open = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.col("__round").isNull())
        now = now.withColumn("__open", is_open)
        now = now.withColumn("__rank", F.row_number().over(Window.partitionBy("type", "__open", *keys, "__own").orderBy("field", "place")))
        # of each rank there is one on a side
        pair = Window.partitionBy("type", "__open", *keys, "__rank")
        now = now.withColumns({"__two": F.count("*").over(pair), "__other": F.max(F.when(~F.col("__own"), F.struct("place", "uid", "path", "field_type"))).over(pair)})
        hit = F.col("__open") & (F.col("__two") == 2)
        now = now.withColumns({"__to": F.when(hit, F.col("__other")).otherwise(F.col("__to")), "__round": F.when(hit, number).otherwise(F.col("__round"))})
    return now.where("__own").select("type", "field", F.col("__round").alias("round"), *[F.col("__to")[c].alias(c) for c in ("place", "uid", "path", "field_type")])


def rematched(mapped: DataFrame, destination: DataFrame, rounds: tuple[tuple[str, ...], ...] = ROUNDS, most: int = MOST) -> DataFrame:
    """(type, field, round, place, uid, path, field_type): for each mapped field what it is in the changed destination.

    mapped: (type, field, uid, path), field being unique in a type; destination: (type, place, uid, path, field_type), place
    being unique in a type. path is the labels from the root. Each round joins what is left on both sides on its keys, and a
    match takes both out: of several with equal keys the first field by name gets the first by place, the second
    the second, and so on, so that no destination field is given twice. round counts from 0; a field that matches in none has nulls and goes
    back to what it was inferred as. A null uid or path matches nothing. Types of up to `most` rows on both sides together
    are settled each in one task, larger ones by range sorts of all. Stored.
    """
    none = lambda c, df: F.lit(None).cast(df.schema[c].dataType).alias(c)
    own = mapped.select("type", F.lit(True).alias("__own"), "field", none("place", destination), "uid", "path", none("field_type", destination))
    other = destination.where("type IS NOT NULL").select("type", F.lit(False).alias("__own"), none("field", mapped), "place", "uid", "path", "field_type")
    every = stored(own.unionByName(other))
    rows = every.where("type IS NOT NULL")
    large = stored(rows.groupBy("type").count().where(F.col("count") > most).select("type"))
    lost = every.where("type IS NULL").select("type", "field", *_nothing(destination))
    if large.isEmpty():
        result = stored(_within_types(rows, rounds).unionByName(lost))
    else:
        large_rows = stored(rows.join(large, "type", "left_semi"))
        ranged = _by_ranges(large_rows.where("__own").select("type", "field", "uid", "path"), large_rows.where("NOT __own").select("type", "place", "uid", "path", "field_type"), rounds)
        result = stored(_within_types(rows.join(large, "type", "left_anti"), rounds).unionByName(ranged).unionByName(lost))
        dropped(large_rows, ranged)
    dropped(every, large)
    return result
