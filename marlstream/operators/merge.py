"""Grouping, deduplication, and merging of models. Order is always a column: first and last are never left to chance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_wins(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """One row for each key, that of the greatest order. A pre-aggregated max, so a frequent key is no burden."""
    return _extreme(rows, keys, order, F.max)


def first_wins(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    return _extreme(rows, keys, order, F.min)


def _extreme(rows: DataFrame, keys: list[str], order, pick) -> DataFrame:
    order = [order] if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys and c not in order]
    found = rows.groupBy(*keys).agg(pick(F.struct(*order, *rest)).alias("__row"))
    return found.select(*keys, "__row.*").select(*rows.columns)


def first_non_null(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Merges rows of a key column by column: the first value that isn't null."""
    rest = [c for c in rows.columns if c not in [*keys, order]]
    value = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c))))[c]
    return rows.groupBy(*keys).agg(*[value(c).alias(c) for c in rest])


def upsert(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The new rows, and the existing ones whose key no new row has."""
    return existing.join(new, keys, "left_anti").unionByName(new, allowMissingColumns=True)


def minus(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(others, keys, "left_anti")


def merged_schema(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The source's fields, and those of the target that it lacks."""
    return source.unionByName(target.join(source, keys, "left_anti"), allowMissingColumns=True)


def folded_choices(rows: DataFrame, value: str, key: str, order: str) -> DataFrame:
    """Choices of one value become one, its keys joined by slashes in order."""
    return rows.groupBy(value).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, key))), lambda x: x[key]), "/").alias(key))


def richer(rows: DataFrame, key: str, size: Column, order: str) -> DataFrame:
    """Of schemas of one component the one with the most top-level keys; of equals the first."""
    kept = rows.withColumn("__size", size)
    rest = [F.col(c) for c in rows.columns if c not in (key, order)]
    best = kept.groupBy(key).agg(F.max(F.struct("__size", (-F.col(order)).alias("__order"), F.col(order), *rest)).alias("x"))
    return best.select(key, "x.*").select(*rows.columns)


def unique_titles(rows: DataFrame, title: str, uid: str) -> DataFrame:
    """The first row of a title, by uid, keeps it; the others get their uid added. The firsts are found by a
    pre-aggregated min and joined, so a title that most rows share is never gathered in one task."""
    first = rows.where(F.col(title).isNotNull()).groupBy(title).agg(F.min(uid).alias("__first"))
    own = F.when(F.col(uid) == F.col("__first"), F.col(title)).otherwise(F.concat(F.col(title), F.lit(" - "), F.col(uid).cast("string")))
    return rows.join(first, title, "left").withColumn(title, own).drop("__first").select(*rows.columns)


def valid_mapping(rows: DataFrame, keys: list[str], kind: str, uid: str) -> DataFrame:
    """Status of each content type: 2 if all its fields are mapped, else 3."""
    mapped = F.coalesce((F.col(kind) != "") & (F.col(kind) != "No matches found") & (F.col(uid) != ""), F.lit(False))
    return rows.groupBy(*keys).agg(F.when(F.bool_and(mapped), 2).otherwise(3).alias("status"))
