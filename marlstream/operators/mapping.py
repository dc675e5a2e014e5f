"""Field mappings: type tables, and the compiler from mapping rows to a projection.

A mapping has a row for each field, a few thousand at most for a content type, whatever the content's size: it is read on
the driver and becomes one `select`, which Catalyst prunes and pushes down like any other.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import values as V

#: fixed values: (source type, widget or "") -> destination type
SECTION_TYPES = {
    ("Symbol", ""): "single_line_text", ("Symbol", "singleLine"): "single_line_text", ("Symbol", "slugEditor"): "single_line_text", ("Symbol", "urlEditor"): "link", ("Symbol", "dropdown"): "dropdown", ("Symbol", "radio"): "radio",
    ("Text", ""): "multi_line_text", ("Text", "multipleLine"): "multi_line_text", ("Text", "markdown"): "markdown", ("RichText", ""): "json", ("Integer", ""): "number", ("Number", ""): "number", ("Date", ""): "isodate",
    ("Boolean", ""): "boolean", ("Object", ""): "json", ("Location", ""): "group", ("Array", "checkbox"): "checkbox", ("Array", "tagEditor"): "json", ("Array", "entryLinksEditor"): "reference", ("Array", "assetLinksEditor"): "file", ("Link", "entryLinkEditor"): "reference", ("Link", "assetLinkEditor"): "file",
}
#: fixed values: field type of an item tree -> destination type
ITEM_TYPES = {
    "Single-Line Text": "single_line_text", "Multi-Line Text": "multi_line_text", "Rich Text": "json", "Checkbox": "boolean", "Date": "isodate", "Datetime": "isodate", "Number": "number", "Integer": "number", "Image": "file", "File": "file",
    "General Link": "link", "Droplink": "dropdown", "Droplist": "dropdown", "Treelist": "reference", "Multilist": "reference", "Droptree": "reference",
}
#: fixed values: inferred JSON type of a page component's property -> destination type
INFERRED_TYPES = {"string": "single_line_text", "integer": "number", "number": "number", "boolean": "boolean", "object": "group", "array": "group"}
#: fixed values: destination type -> data type of the schema
DATA_TYPES = {
    "single_line_text": "text", "text": "text", "multi_line_text": "text", "markdown": "text", "html": "text", "json": "json", "number": "number", "boolean": "boolean", "isodate": "isodate", "dropdown": "text", "radio": "text", "checkbox": "text",
    "file": "file", "link": "link", "reference": "reference", "group": "group", "modular_blocks": "blocks", "global_field": "global_field", "app": "json", "extension": "json",
}


def mapped_type(source: Column, table: dict, widget: Column | None = None, default: str = "reference") -> Column:
    """Destination type by a type table; a pair that it lacks falls back to the type alone, then to the default."""
    key = lambda k: k if isinstance(k, str) else "\x1f".join(k)
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(key(k)), F.lit(v))])
    if widget is None:
        return F.coalesce(F.try_element_at(known, source), F.lit(default))
    pair = F.concat_ws("\x1f", source, F.coalesce(widget, F.lit("")))
    return F.coalesce(F.try_element_at(known, pair), F.try_element_at(known, F.concat(source, F.lit("\x1f"))), F.lit(default))


def field_schema(uid: Column, title: Column, kind: Column, mandatory: Column, multiple: Column, description: Column) -> Column:
    """A field of the destination schema, as JSON."""
    known = F.create_map(*[F.lit(x) for pair in DATA_TYPES.items() for x in pair])
    extras = F.struct(
        F.when(kind == "multi_line_text", True).alias("multiline"), F.when(kind == "markdown", True).alias("markdown"), F.when(kind == "html", True).alias("allow_rich_text"),
        F.substring(description, 1, 255).alias("description"),
    )
    return F.to_json(F.struct(F.coalesce(F.try_element_at(known, kind), F.lit("text")).alias("data_type"), title.alias("display_name"), uid.alias("uid"), extras.alias("field_metadata"), F.coalesce(mandatory, F.lit(False)).alias("mandatory"), F.coalesce(multiple, F.lit(False)).alias("multiple")))


@dataclass(frozen=True)
class Mapping:
    source: str
    target: str
    kind: str
    multiple: bool = False
    options: tuple[tuple[str, str], ...] = field(default=())
    default: str | None = None


def coerced(column: Column, rule: Mapping) -> Column:
    """A text cell as the destination type wants it."""
    if rule.kind == "number":
        out = V.leading_integer(column)
    elif rule.kind == "boolean":
        out = V.flag(column)
    elif rule.kind in ("isodate", "date"):
        out = V.iso_date(column)
    elif rule.kind in ("dropdown", "radio", "checkbox") and rule.options:
        options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in rule.options])
        out = V.choice(options, column, F.lit(rule.default))
    elif rule.kind == "link":
        out = F.when(column.isNotNull(), F.struct(column.alias("title"), column.alias("href")))
    elif rule.kind == "reference":
        out = F.transform(F.filter(F.split(column, r"\|"), lambda x: x != ""), lambda x: F.struct(F.lower(F.regexp_replace(x, "[-{}]", "")).alias("uid")))
    else:
        out = column
    if rule.multiple and rule.kind != "reference":
        out = F.when(out.isNotNull(), F.array(out))
    return out


def projected(df: DataFrame, rules: Iterable[Mapping], keep: Iterable[str] = ()) -> DataFrame:
    """df with the mapped fields under their destination names; a source column that df lacks gives null."""
    made = []
    for rule in rules:
        cell = F.col(f"`{rule.source}`").cast("string") if rule.source in df.columns else F.lit(None).cast("string")
        made.append(coerced(cell, rule).alias(rule.target))
    return df.select(*keep, *made)


def projected_by_rows(entries: DataFrame, keys: list[str], fields: DataFrame, mapping: DataFrame) -> DataFrame:
    """The same for mappings too many to compile, one for each content type: fields (keys, content_type, field, value)
    joined to mapping (content_type, field, target), the last segment of a dotted source being its field."""
    rules = mapping.withColumn("field", F.try_element_at(F.split("source", r"\."), F.lit(-1))).select("content_type", "field", "target")
    hit = fields.join(rules, ["content_type", "field"])
    made = hit.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("target", "value")))).alias("entry"))
    return entries.join(made, keys, "left")


def selected(mapper_keys: Column, uid: Column) -> Column:
    """Destination type of a content type: the mapped key or its own."""
    return F.coalesce(F.try_element_at(mapper_keys, uid), uid)


def projected_json(df: DataFrame, payload: str, rules: Iterable[Mapping], keep: Iterable[str] = ()) -> DataFrame:
    """As projected, for fields inside a JSON column: the source is a dotted path, of any depth."""
    path = lambda rule: "$" + "".join(f"['{part}']" for part in rule.source.split("."))
    return df.select(*keep, *[coerced(F.get_json_object(payload, path(r)), r).alias(r.target) for r in rules])


def advanced(validations: Column, required: Column, localized: Column, description: Column, default: Column) -> Column:
    """Advanced settings of a field: the first pattern of its validations, and flags."""
    return F.struct(
        F.get(F.filter(validations, lambda x: x.isNotNull()), F.lit(0)).alias("validation_regex"), F.coalesce(required, F.lit(False)).alias("mandatory"),
        (~F.coalesce(localized, F.lit(False))).alias("non_localizable"), F.substring(description, 1, 255).alias("description"), default.alias("default_value"),
    )
