"""Search predicates and pages. A page is always taken under a total order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(column: str | Column, text: str | None) -> Column:
    """Case-insensitive substring; a null cell never matches, and an empty or "null" text matches all."""
    if text in (None, "", "null"):
        return F.lit(True)
    cell = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.contains(F.lower(cell.cast("string")), F.lower(F.lit(text))), F.lit(False))


def matches_any(columns: list[str], text: str | None) -> Column:
    """True if any of the columns contains the text."""
    return reduce(Column.__or__, [matches(c, text) for c in columns]) if columns else F.lit(text in (None, "", "null"))


def string_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind == "string"]


def matches_choice(column: str, choices: str, separator: str = "-") -> Column:
    """True if the cell contains any of the separated choices, ignoring case; "all" matches everything."""
    if choices == "all":
        return F.lit(True)
    return reduce(Column.__or__, [matches(column, c) for c in choices.split(separator) if c])


def page(df: DataFrame, order: list[str | Column], offset: int, limit: int) -> DataFrame:
    """Rows offset .. offset + limit - 1. Spark plans this as a top-k per task, never as a full sort."""
    return df.orderBy(*order).offset(offset).limit(limit)
