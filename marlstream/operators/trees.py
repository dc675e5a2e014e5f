"""Trees that are kept as dotted paths. A path's ancestors are its prefixes, so closures need no iteration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parts(path: Column, separator: str = ".") -> Column:
    return F.filter(F.split(path, F.lit("\\Q" + separator + "\\E")), lambda x: x != "")


def depth(path: Column, separator: str = ".") -> Column:
    return F.size(parts(path, separator))


def parent(path: Column, separator: str = ".") -> Column:
    """Path without its last part; null at the root."""
    each = parts(path, separator)
    return F.when(F.size(each) > 1, F.array_join(F.slice(each, F.lit(1), F.size(each) - 1), separator))


def leaf(path: Column, separator: str = ".") -> Column:
    return F.try_element_at(parts(path, separator), F.lit(-1))


def prefixes(path: Column, separator: str = ".") -> Column:
    """The path and all its ancestors, the root first."""
    each = parts(path, separator)
    return F.when(F.size(each) > 0, F.transform(F.sequence(F.lit(1), F.size(each)), lambda i: F.array_join(F.slice(each, F.lit(1), i), separator))).otherwise(F.array().cast("array<string>"))


def closure(df: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """(path, depth) of every path and every ancestor."""
    return df.select(F.explode(prefixes(F.col(column), separator)).alias("path")).distinct().select("path", depth(F.col("path"), separator).alias("depth"))


def with_parents(nodes: DataFrame, column: str, separator: str = ".") -> DataFrame:
    """nodes with `parent` and `is_orphan`: if the parent isn't a node itself."""
    own = nodes.withColumn("parent", parent(F.col(column), separator))
    known = nodes.select(F.col(column).alias("parent"), F.lit(True).alias("__known")).where("parent IS NOT NULL").distinct()
    return own.join(known, "parent", "left").withColumn("is_orphan", F.col("parent").isNotNull() & F.col("__known").isNull()).drop("__known")


def descendants(nodes: DataFrame, column: str, roots: DataFrame, root: str, separator: str = ".") -> DataFrame:
    """(root, path) of every node below a root: an equi-join on the nodes' prefixes, not a comparison of all pairs."""
    each = nodes.select(column, F.explode(prefixes(F.col(column), separator)).alias(root))
    return each.join(roots.select(root), root).where(F.col(root) != F.col(column)).distinct()


def child_counts(nodes: DataFrame, column: str, separator: str = ".") -> DataFrame:
    return nodes.select(parent(F.col(column), separator).alias("path")).where("path IS NOT NULL").groupBy("path").agg(F.count("*").alias("n_children"))


def checked_upwards(nodes: DataFrame, column: str, checked: str, separator: str = ".") -> DataFrame:
    """(path, checked): a node is checked if it, or any node below it, is."""
    return nodes.select(F.explode(prefixes(F.col(column), separator)).alias("path"), checked).groupBy("path").agg(F.bool_or(checked).alias("checked"))


def nested(rows: DataFrame, keys: list[str], parent_column: str, order: str, payload: list[str], name: str = "children") -> DataFrame:
    """One level of nesting: the rows of a parent as an ordered array of structs. Applied from the deepest level up."""
    items = F.collect_list(F.struct(order, *[c for c in payload if c != order]))
    return rows.groupBy(*keys, parent_column).agg(F.array_sort(items).alias(name))
