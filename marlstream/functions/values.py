"""Coercions of loosely typed values, dates, and small array and map functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leading_integer(text: Column) -> Column:
    """The integer that a text starts with, or null."""
    return F.nullif(F.regexp_extract(text, r"^\s*([+-]?\d+)", 1), F.lit("")).try_cast("bigint")


def number(text: Column) -> Column:
    """The whole text as a number; null if it is blank or none."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def is_one(text: Column) -> Column:
    return F.coalesce(text == "1", F.lit(False))


def flag(text: Column) -> Column:
    """Truth of a text: the words for yes and no; any other text is true, an absent one false."""
    word = F.trim(F.lower(text))
    return F.when(text.isNull(), False).when(word.isin("false", "no", "0", ""), False).otherwise(True)


def flag_of_number(n: Column) -> Column:
    return F.coalesce(n != 0, F.lit(False))


def or_else(*columns: Column) -> Column:
    """The first text that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def stable_id(*parts: Column) -> Column:
    """An identifier that a rerun gives again."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)


def row_id(given: Column, *parts: Column) -> Column:
    """The given identifier without braces, lower-cased; else a stable one."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(given, "[{}]", "")), F.lit("")), stable_id(*parts))


def json_bytes(row: Column) -> Column:
    return F.octet_length(F.to_json(row))


ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso(moment: Column) -> Column:
    return F.date_format(moment, ISO)


def iso_date(text: Column) -> Column:
    """A compact or usual date text as ISO 8601; null if it is none."""
    return iso(F.coalesce(F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss'Z'")), text.try_cast("timestamp")))


def feed_date(text: Column) -> Column:
    """As iso_date; dates of the year 0 are null."""
    return F.when(~F.startswith(text, F.lit("0000")), iso_date(text))


def as_array(column: Column) -> Column:
    """The value alone in an array; an empty array for null."""
    return F.when(column.isNotNull(), F.array(column)).otherwise(F.array().cast("array<string>"))


def key_values(entries: Column) -> Column:
    """Map to an array of structs, in key order."""
    return F.array_sort(F.map_entries(entries))


def choice(options: Column, value: Column, default: Column) -> Column:
    """The value of the first option whose key or value fits, else the default."""
    found = F.get(F.filter(options, lambda o: (o["key"] == value) | (o["value"] == value)), F.lit(0))
    return F.coalesce(found["value"], default)


def choices(options: Column) -> Column:
    """Options without nulls; one stand-in if there are none."""
    kept = F.filter(options, lambda o: o.isNotNull() & o["value"].isNotNull())
    stand_in = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("NF").alias("value")))
    return F.when(kept.isNull() | (F.size(kept) == 0), stand_in).otherwise(kept)


def has_keys(options: Column) -> Column:
    return F.exists(options, lambda o: o["key"].isNotNull())


def truthy(values: Column) -> Column:
    """Array without nulls and empty texts."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def without_keys(entries: Column, keys: list[str]) -> Column:
    return F.map_filter(entries, lambda k, _: ~k.isin(*keys))


def last_wins(first: Column, later: Column) -> Column:
    """Union of two maps; the later one wins. Needs no session setting, unlike map_concat."""
    kept = F.map_filter(first, lambda k, _: ~F.array_contains(F.map_keys(later), k))
    return F.map_concat(kept, later)


def union_distinct(a: Column, b: Column) -> Column:
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def upper_median(values: Column) -> Column:
    """The element at half the length, rounded down, of the sorted values."""
    ordered = F.array_sort(values)
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def in_order(items: Column, order: Column) -> Column:
    """Values of a map in the order of a key array; keys that the map lacks are left out."""
    return F.filter(F.transform(order, lambda k: F.try_element_at(items, k)), lambda x: x.isNotNull())


def siblings(order: Column, base: str) -> Column:
    """Of ordered keys the base and its numbered siblings."""
    return F.filter(order, lambda k: k.rlike(rf"^{base}(_.*)?$"))


def moved(values: Column, source: int, target: int) -> Column:
    """The array with its element at `source` put at `target`, both from 0."""
    item = F.get(values, F.lit(source))
    rest = F.filter(values, lambda _, i: i != source)
    return F.concat(F.slice(rest, 1, target), F.array(item), F.slice(rest, F.lit(target + 1), F.greatest(F.size(rest) - target, F.lit(0))))


def table_shape(rows: Column) -> Column:
    """(rows, most columns in a row) of an array of arrays."""
    return F.struct(F.size(rows).alias("n_rows"), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)).alias("n_columns"))


def projected_objects(objects: Column, required: str, fields: list[str]) -> Column:
    """Of an array of structs those with the required field, cut to some fields."""
    return F.transform(F.filter(objects, lambda x: x[required].isNotNull()), lambda x: F.struct(*[x[f].alias(f) for f in fields]))


def any_true(objects: Column, field: str) -> Column:
    """If any struct of the array has the flag, such as an administrator's role."""
    return F.coalesce(F.exists(objects, lambda x: F.coalesce(x[field], F.lit(False))), F.lit(False))


def references(uids: Column, content_type: str) -> Column:
    """Array of reference structs; empty ids and the parent id 0 give none."""
    kept = F.filter(uids, lambda x: x.isNotNull() & ~x.isin("", "0"))
    return F.transform(kept, lambda x: F.struct(x.alias("uid"), F.lit(content_type).alias("_content_type_uid")))
