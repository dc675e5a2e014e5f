"""Positions, chunks and carried values.

A running number over a whole table must not send it to one task. Rows are sorted by range instead, each task counts (or
sums) its own, and the per-task totals, a row for each task, are broadcast to say where each task begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstream.session import stored


def _placed(df: DataFrame, order: list[str | Column]) -> DataFrame:
    """df in order, with the number of the task that has a row, and the row's place there from 0. It is stored, as a
    second run of the sort might deal the rows out otherwise."""
    at = F.monotonically_increasing_id()
    placed = df.orderBy(*order).withColumn("__at", at)
    return stored(placed.withColumn("__task", F.shiftright("__at", 33)).withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))))


def _before(totals: DataFrame) -> DataFrame:
    """(__task, __before) from (__task, __sum), a row for each task."""
    earlier = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("__task", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))


def numbered(df: DataFrame, order: list[str], name: str = "n") -> DataFrame:
    """df with 1, 2, ... in a total order."""
    placed = _placed(df, order)
    before = _before(placed.groupBy("__task").agg(F.count("*").alias("__sum")))
    return placed.join(F.broadcast(before), "__task").withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__task", "__at", "__before")


def chunks_by_count(df: DataFrame, order: list[str], size: int = 100, name: str = "chunk") -> DataFrame:
    return numbered(df, order, "__n").withColumn(name, F.floor((F.col("__n") - 1) / size).cast("long")).drop("__n")


def chunks_by_bytes(df: DataFrame, order: list[str], payload: Column, most: int = 1 << 20, name: str = "chunk") -> DataFrame:
    """Chunks of about `most` bytes: the bytes before a row decide, so a chunk overshoots by a row at most."""
    placed = _placed(df.withColumn("__bytes", payload.cast("long")), order)
    before = _before(placed.groupBy("__task").agg(F.sum("__bytes").alias("__sum")))
    own = Window.partitionBy("__task").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.coalesce(F.sum("__bytes").over(own), F.lit(0)) + F.col("__before")
    return placed.join(F.broadcast(before), "__task").withColumn(name, F.floor(upto / most).cast("long")).drop("__task", "__at", "__before", "__bytes")


def trimmed(df: DataFrame, order: list[str], head: int = 1, tail: int = 2) -> DataFrame:
    """Without the first and the last rows. Only the few bounding rows are found, each by a top-k."""
    first = df.select(*order).orderBy(*order).limit(head)
    last = df.select(*order).orderBy(*[F.desc(c) for c in order]).limit(tail)
    return df.join(F.broadcast(first.union(last)), order, "left_anti")


def carried(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value so far within a group, such as the header that a row belongs to."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def appearance_order(df: DataFrame, key: str, order: str, name: str = "rank") -> DataFrame:
    """Keys numbered from 1 as they first appear."""
    first = df.groupBy(key).agg(F.min(order).alias("__first"))
    return numbered(first, ["__first", key], name).drop("__first")


def upper_medians(df: DataFrame, group: str, value: str, name: str = "median") -> DataFrame:
    """(group, median): the value at half a group's length, rounded down, of its sorted values, nulls last. Equal values are
    counted, the counts sorted by ranges, and of each group only the task that holds its middle is looked through."""
    counts = df.groupBy(F.col(group).alias("__group"), F.col(value).alias("__value")).agg(F.count("*").alias("__n"))
    placed = _placed(counts, ["__group", F.asc_nulls_last("__value")])
    so_far = lambda w, x: F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    tasks = placed.groupBy(F.col("__group").alias("__g"), F.col("__task").alias("__t")).agg(F.sum("__n").alias("__sum"))
    own = Window.partitionBy("__g")
    tasks = tasks.withColumn("__before", so_far(own.orderBy("__t"), "__sum") - F.col("__sum"))
    tasks = tasks.withColumn("__wanted", F.floor(F.sum("__sum").over(own) / 2) - F.col("__before")).where("__wanted >= 0 AND __wanted < __sum")
    middle = placed.join(tasks, F.col("__group").eqNullSafe(F.col("__g")) & (F.col("__task") == F.col("__t")))
    middle = middle.withColumn("__upto", so_far(Window.partitionBy("__group", "__task").orderBy("__at"), "__n"))
    return middle.where("__upto - __n <= __wanted AND __wanted < __upto").select(F.col("__group").alias(group), F.col("__value").alias(name))


def samples(df: DataFrame, group: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows for each group and task before it shuffles."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")
