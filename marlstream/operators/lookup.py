"""Lookup joins. Reference, asset and locale tables are left to Spark's own size check for broadcasting: they grow with
the content, so no side is forced to be broadcast; skewed keys are split by adaptive execution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_children(parents: DataFrame, list_column: str, children: DataFrame, key: str) -> DataFrame:
    """Rows of a foreign-key array joined to their children, with `pos`, the place in the array; missing ones stay."""
    one = parents.select("*", F.posexplode(list_column).alias("pos", key)).drop(list_column)
    return one.join(children, key, "left")


def right_biased(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which non-null columns of the right table replace those of the same name."""
    shared = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.select(*keys, *[F.col(c).alias(f"__{c}") if c in shared else F.col(c) for c in right.columns if c not in keys])
    joined = left.join(renamed, keys, "left")
    own = [F.coalesce(f"__{c}", c).alias(c) if c in shared else F.col(c) for c in left.columns]
    return joined.select(*own, *[c for c in right.columns if c not in left.columns])


def resolve_references(rows: DataFrame, id_column: str, refs: str | Column, index: DataFrame, ref_key: str, value: str) -> DataFrame:
    """(id, found): for each row the values of its references, in order; dangling ones are left out."""
    array = F.col(refs) if isinstance(refs, str) else refs
    each = rows.select(id_column, F.posexplode_outer(array).alias("pos", ref_key))
    hit = each.join(index.select(ref_key, value), ref_key, "left")
    found = F.collect_list(F.when(F.col(value).isNotNull(), F.struct("pos", value)))
    return hit.groupBy(id_column).agg(F.transform(F.array_sort(found), lambda x: x[value]).alias("found"))


def by_candidates(rows: DataFrame, id_column: str, candidates: list[Column], index: DataFrame, key: str, value: str) -> DataFrame:
    """Left join on several spellings of a key: the first candidate that the index has gives the value."""
    each = rows.select(id_column, F.posexplode(F.array(*candidates)).alias("priority", key))
    hit = each.join(index.select(key, value), key)
    best = hit.groupBy(id_column).agg(F.min_by(value, "priority").alias(value), F.min("priority").alias("priority"))
    return rows.join(best, id_column, "left")


def by_parent_type(components: DataFrame, type_column: str) -> DataFrame:
    """Each component with the one whose type is its own without the last segment."""
    parent = F.regexp_replace(type_column, "/[^/]+$", "")
    own = components.withColumn("parent_type", parent)
    others = components.select(*[F.col(c).alias(f"parent_{c}") for c in components.columns]).withColumnRenamed(f"parent_{type_column}", "parent_type")
    return own.join(others.where(F.col("parent_type").isNotNull()), "parent_type", "left")


def compatible(fields: DataFrame, field_type: str, rules: DataFrame, targets: DataFrame, target_type: str) -> DataFrame:
    """Fields with every target field that the compatibility table (source_type, target_type) allows: an equi-join
    through the table, where trying all pairs would be a cross join."""
    allowed = fields.join(rules, F.col(field_type) == F.col("source_type")).drop("source_type")
    return allowed.join(targets, F.col("target_type") == F.col(target_type)).drop("target_type")


def replicated(rows: DataFrame, locales: list[str], column: str = "locale") -> DataFrame:
    """Every row once for each locale: an array of literals is exploded, so there is no join."""
    return rows.withColumn(column, F.explode(F.array(*[F.lit(x) for x in locales])))


def repaired(entries: DataFrame, key: str, ref_type: str, ref_uid: str, index: DataFrame, index_type: str, index_uid: str) -> DataFrame:
    """Dangling references get the first entry of the type that they name."""
    least = index.groupBy(F.col(index_type).alias(ref_type)).agg(F.min(index_uid).alias("__first"))
    known = index.select(F.col(index_type).alias(ref_type), F.col(index_uid).alias(ref_uid), F.lit(True).alias("__known")).distinct()
    joined = entries.join(known, [ref_type, ref_uid], "left").join(least, ref_type, "left")
    return joined.withColumn(ref_uid, F.when(F.col("__known"), F.col(ref_uid)).otherwise(F.col("__first"))).drop("__known", "__first")


def first_match(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the first in the given order. A pre-aggregated minimum, so that no key is gathered in one task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x")).select(*keys, "__x.*").select(*rows.columns)
