"""Fields of the destination's content types, and the values that they take.

A field's schema depends on its kind and its settings alone, so all fields of all content types are one projection; apps
are the only join. Values are coerced in long form, a row for each entry and field, where references, files and choices are
resolved by equi-joins of their own and the rest by expressions; `entries` puts the rows of an entry together again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import documents as D
from marlstream.functions import text as X
from marlstream.functions import values as V
from marlstream.session import dropped, stored

#: fixed values: kind of a field -> data type
KINDS = {
    "single_line_text": "text", "multi_line_text": "text", "markdown": "text", "html": "text", "dropdown": "text", "radio": "text", "checkbox": "text", "number": "number", "boolean": "boolean", "isodate": "isodate",
    "json": "json", "file": "file", "link": "link", "reference": "reference", "global_field": "global_field", "app": "json", "extension": "json",
}
#: fixed values: types of the source whose choices are numbers, whose JSON has an editor of its own, and that are lists
NUMBER_CHOICES = ("dropdownNumber", "radioNumber", "ratingNumber")
OBJECTS = ("Object", "Array")
LISTS = ("listInput", "tagEditor")
#: fixed values: extensions, and what stands for all files
OBJECT_EXTENSION, LIST_EXTENSION = "jsonobject_extension", "list_extension"
FILES = "sys_assets"
#: columns of a field's settings; references and embedded are arrays of content types, options of (key, value)
SETTINGS = ("default_value", "default_key", "description", "regex", "message", "multiple", "mandatory", "unique", "non_localizable", "options", "embedded", "link_title", "link_url")


def _variant(value: str) -> Column:
    return F.parse_json(F.lit(value))


def _json_text(column: Column) -> Column:
    return column.cast("variant")


def field_schemas(fields: DataFrame, apps: DataFrame) -> DataFrame:
    """fields with `schema`, the JSON of each field; null for a field without a kind, an app that apps (title, app_uid)
    lacks, and an extension that is no list. Settings that are null are left out.

    fields: uid, title, kind, source_type, source_field, references and SETTINGS. An app's name stands in parentheses in
    source_field."""
    inner = F.nullif(F.regexp_extract("source_field", r"\(([^)]+)\)", 1), F.lit(""))
    name = F.trim(F.replace(F.coalesce(inner, F.col("source_field")), F.lit("-App"), F.lit("")))
    known = apps.groupBy(F.col("title").alias("__app")).agg(F.min("app_uid").alias("__app_uid"))
    rows = fields.withColumn("__name", name).join(known, F.col("__name") == F.col("__app"), "left")
    return rows.withColumn("schema", _schema()).drop("__name", "__app", "__app_uid")


def _schema() -> Column:
    kind, source = F.col("kind"), F.col("source_type")
    of = lambda *kinds: kind.isin(*kinds)
    default, on = F.col("default_value"), F.lit(True)
    objects = (kind == "json") & F.coalesce(source.isin(*OBJECTS), F.lit(False))
    rich = (kind == "json") & ~objects
    chosen = of("dropdown", "radio", "checkbox")
    other = ~of(*KINDS)
    uid = X.field_uid(F.col("uid"))
    given = lambda c: F.coalesce(F.col(c), F.lit(False))
    embedded = F.when(F.size("embedded") > 0, F.transform("embedded", X.flat_uid))
    none = F.array().cast("array<string>")
    # an editor that embeds files only says nothing of what it embeds
    only_files = embedded.isNull() | (F.col("embedded") == F.array(F.lit(FILES)))
    # choices: those that are there, or one stand-in if none were given
    own = F.filter("options", lambda o: o.isNotNull())
    choices = F.when(F.size("options") > 0, own).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("key"), F.lit("NF").alias("value"))))
    of_key = F.get(F.filter("options", lambda o: o["key"] == default), F.lit(0))["value"]
    told = (
        F.when(of("single_line_text", "multi_line_text", "number"), _json_text(F.coalesce(default, F.lit(""))))
        .when(kind == "boolean", F.coalesce(default == "true", F.lit(False)).cast("variant"))
        .when(rich, _variant('""'))
        .when(kind == "dropdown", _json_text(F.when(F.size("options") > 0, of_key).otherwise(default)))
        .when(of("radio", "checkbox"), _json_text(default))
        .when(kind == "link", F.to_variant_object(F.struct(F.coalesce("link_title", F.lit("")).alias("title"), F.coalesce("link_url", F.lit("")).alias("url"))))
        .when(kind == "isodate", _variant("{}"))
    )
    described = F.when(of("radio", "checkbox") | objects, F.coalesce("description", F.lit(""))).when(of("single_line_text", "boolean", "dropdown", "file", "link", "multi_line_text", "markdown", "number", "isodate", "html") | rich, "")
    metadata = F.struct(
        described.alias("description"), told.alias("default_value"), F.when(of("radio", "checkbox"), F.coalesce("default_key", F.lit(""))).alias("default_key"),
        F.when(objects | of("app", "extension"), on).alias("extension"), F.when(rich, on).alias("allow_json_rte"), F.when(kind == "html", on).alias("allow_rich_text"),
        F.when(rich, embedded.isNotNull()).when((kind == "html") & ~only_files, on).alias("embed_entry"),
        F.when(kind == "multi_line_text", on).when(rich | (kind == "html"), False).alias("multiline"), F.when(kind == "markdown", on).alias("markdown"),
        F.when(kind == "markdown", F.coalesce(default, F.lit(""))).alias("placeholder"), F.when(rich | (kind == "html"), "advanced").when(kind == "file", "standard").alias("rich_text_type"),
        F.when(rich | (kind == "html"), none).alias("options"), F.when(kind == "html", 3).alias("version"), F.when(kind == "isodate", on).alias("hide_time"),
        F.when(kind == "reference", on).alias("ref_multiple"), F.when((kind == "reference") | ((kind == "html") & ~only_files), on).alias("ref_multiple_content_types"), F.when(other, on).alias("_default"),
    )
    checked = ~of("html", "global_field", "app", "extension")
    types = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    made = F.struct(
        F.when(of("dropdown", "radio") & source.isin(*NUMBER_CHOICES), "number").otherwise(F.coalesce(F.try_element_at(types, kind), F.lit("text"))).alias("data_type"),
        F.when(kind == "json", F.coalesce("title", uid)).when(kind == "app", F.split("title", " ")[0]).otherwise(F.col("title")).alias("display_name"),
        uid.alias("uid"), F.when(chosen, kind).alias("display_type"),
        F.when(chosen, F.struct(F.exists(choices, lambda o: o["key"].isNotNull()).alias("advanced"), choices.alias("choices"))).alias("enum"),
        F.when(objects, F.lit(OBJECT_EXTENSION)).when(kind == "app", F.col("__app_uid")).when(kind == "extension", F.lit(LIST_EXTENSION)).alias("extension_uid"),
        F.when(objects | of("app", "extension"), F.create_map().cast("map<string,string>")).alias("config"), F.when(kind == "file", none).alias("extensions"),
        F.when(kind != "global_field", metadata).alias("field_metadata"),
        F.when(objects, F.array(F.lit(FILES))).when(rich, F.concat(F.array(F.lit(FILES)), F.coalesce(embedded, none))).when(of("reference", "global_field"), F.coalesce("references", none)).when((kind == "html") & ~only_files, embedded).alias("reference_to"),
        F.when(checked, F.coalesce("regex", F.lit(""))).alias("format"), F.when(checked, F.struct(F.coalesce("message", F.lit("")).alias("format"))).alias("error_messages"),
        F.when(kind == "checkbox", True).otherwise(given("multiple")).alias("multiple"), given("mandatory").alias("mandatory"), given("unique").alias("unique"),
        F.when(objects, False).when(kind != "global_field", given("non_localizable")).alias("non_localizable"),
    )
    there = F.when(kind == "app", F.col("__app_uid").isNotNull()).when(kind == "extension", F.coalesce(source.isin(*LISTS), F.lit(False))).otherwise(kind.isNotNull() & (kind != ""))
    return F.when(there, F.to_json(made))


def coerced_values(cells: DataFrame, fields: DataFrame, assets: DataFrame, entries: DataFrame) -> DataFrame:
    """(entry, field, value): what each cell becomes by its field's kind, as JSON text; null for none.

    cells: (entry, locale, field, content); fields: (field, kind, references, multiple, default_value, options), unique by
    field; assets: (asset, record), record being JSON; entries: (entry, template, locale), those that references may name.
    Ids are compared without braces and hyphens. Texts, apps, extensions and kinds that aren't known keep their content; a
    cell of a field that isn't in fields has no row. Rich text and what holds other fields: `coerced_content`."""
    rows = cells.join(fields, "field")
    kind, content, option = F.col("kind"), F.col("content"), F.col("__option")
    fits = lambda value: F.get(F.filter("options", lambda o: (o["key"] == value) | (o["value"] == value)), F.lit(0))
    given = F.nullif(F.col("default_value"), F.lit(""))
    picked = F.coalesce(fits(content), fits(given))
    # the first link of the content, and the first file that it names
    link = F.struct(F.regexp_extract("content", r'<a\s[^>]*?\bid="([^"]*)"', 1).alias("title"), F.regexp_extract("content", r'<a\s[^>]*?\bhref="([^"]*)"', 1).alias("href"))
    plain = rows.withColumn("__option", F.when(kind == "dropdown", picked))
    whole = F.coalesce(F.col("multiple"), F.lit(False))
    value = (
        F.when(kind == "dropdown", F.when(whole, F.to_json(option)).otherwise(F.to_json(option["value"].cast("variant"))))
        .when(kind == "number", V.leading_integer(content).cast("string"))
        .when(kind == "boolean", V.is_one(content).cast("string"))
        .when(kind.isin("date", "isodate"), F.to_json(V.iso_date(F.nullif(content, F.lit(""))).cast("variant")))
        .when(kind == "link", F.to_json(link))
        .otherwise(F.to_json(content.cast("variant")))
    )
    scalars = plain.where(~kind.isin("reference", "file")).select("entry", "field", value.alias("value"))
    media = F.regexp_extract("content", r'\bmediaid="([^"]*)"', 1)
    files = rows.where(kind == "file").select("entry", "field", X.compact_id(media).alias("__asset"))
    held = files.join(assets.select(X.compact_id(F.col("asset")).alias("__asset"), F.col("record").alias("value")), "__asset", "left").select("entry", "field", "value")
    asked = rows.where(kind == "reference").select("entry", "field", "locale", F.posexplode_outer("references").alias("place", "type"), "content")
    asked = asked.select("entry", "field", "locale", "place", "type", F.posexplode_outer(F.split("content", r"\|")).alias("at", "id")).withColumn("id", X.compact_id(F.col("id")))
    there = entries.select(X.compact_id(F.col("entry")).alias("id"), X.flat_uid(F.col("template")).alias("type"), "locale").distinct().withColumn("found", F.lit(True))
    # collect_list leaves out what isn't found
    hit = F.when(F.col("found"), F.struct("place", "at", F.struct(F.col("id").alias("uid"), F.col("type").alias("_content_type_uid")).alias("ref")))
    refs = asked.join(there, ["id", "type", "locale"], "left").groupBy("entry", "field").agg(F.to_json(F.transform(F.array_sort(F.collect_list(hit)), lambda x: x["ref"])).alias("value"))
    return scalars.unionByName(held).unionByName(refs)


def _rich_text(cells: DataFrame, assets: DataFrame) -> DataFrame:
    """(entry, field, value): the node trees of HTML cells, with images that are known assets as references to them."""
    index = assets.select(F.col("asset").alias("src"), F.get_json_object("record", "$.uid").alias("uid")).where("uid IS NOT NULL")
    trees = cells.select("entry", "field", D.html_to_tree(F.col("content")).alias("__tree"))
    return D.with_assets(trees, "__tree", index, "value").select("entry", "field", "value")


def coerced_content(cells: DataFrame, fields: DataFrame, assets: DataFrame, entries: DataFrame, members: DataFrame) -> DataFrame:
    """(entry, field, value) as `coerced_values` has it, and for fields of rich text (kind json) their trees, for fields that hold
    others (groups and global fields) objects of what these make of the same content, at any depth.

    members: (owner, uid, field), what a field holds under which key, unique in an owner; a key with null has one all the same. A field that
    would hold itself, however far down, is left out there. cells are unique by entry and field. One level of all cells is opened by a join at a time, and
    objects are put together by one group-by a level from the inside. A field that holds others by its kind and has none is
    an empty object. Stored.
    """
    holds = F.col("kind").isin("group", "global_field")
    kinds = fields.select("field", "kind")
    # cells are dealt out first, as those of a small file would all be parsed by one task; an id for each, and the owners above it
    top = cells.repartition("entry", "field").join(kinds, "field").select(F.to_json(F.struct(F.col("entry").cast("string").alias("e"), F.col("field").alias("f"))).alias("id"), F.lit(None).cast("string").alias("parent"), F.lit("").alias("uid"), "entry", "locale", "field", "kind", "content", F.array("field").alias("above"))
    now, levels = stored(top), []
    while not now.isEmpty():
        levels.append(now)
        held = now.where(holds).select("id", "entry", "locale", "content", F.col("field").alias("owner"), "above").join(members.withColumnsRenamed({"field": "__member"}), "owner")
        held = held.where(~F.array_contains("above", F.col("__member"))).join(kinds.withColumnRenamed("field", "__member"), "__member")
        below = held.select(F.concat("id", F.lit("/"), "uid").alias("__id"), F.col("id").alias("parent"), "uid", "entry", "locale", F.col("__member").alias("field"), "kind", "content", F.array_append("above", F.col("__member")).alias("above"))
        now = stored(below.withColumnRenamed("__id", "id").select(now.columns))
    if not levels:
        return top.select("entry", "field", F.col("content").alias("value"))
    every = reduce(DataFrame.unionByName, levels)
    leaf = every.where(~F.coalesce(holds, F.lit(False))).withColumn("__entry", F.col("entry")).withColumn("entry", F.col("id"))
    plain = coerced_values(leaf.where("kind IS NULL OR kind <> 'json'").select("entry", "locale", "field", "content"), fields, assets, entries)
    values = stored(plain.unionByName(_rich_text(leaf.where("kind = 'json'"), assets)).select(F.col("entry").alias("id"), "value"))
    done = None
    for level in reversed(levels):
        own = level.select("id", "parent", "uid", "entry", "field", holds.alias("holds")).join(values, "id", "left")
        if done is not None:
            pairs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("uid", F.coalesce("value", F.lit("null")).alias("v")))), lambda x: F.concat(F.to_json(x["uid"].cast("variant")), F.lit(":"), x["v"])), ",")
            objects = done.groupBy(F.col("parent").alias("id")).agg(pairs.alias("inner"))
            own = own.join(objects, "id", "left")
        else:
            own = own.withColumn("inner", F.lit(None).cast("string"))
        whole = F.when(F.col("holds"), F.concat(F.lit("{"), F.coalesce("inner", F.lit("")), F.lit("}"))).otherwise(F.col("value"))
        below, done = done, stored(own.select("id", "parent", "uid", "entry", "field", whole.alias("value")))
        if below is not None:
            dropped(below)
    dropped(values, *levels)
    return done.select("entry", "field", "value")


def entries(values: DataFrame) -> DataFrame:
    """(entry, fields) from rows (entry, field, value): each entry's values by field, without those that are null. Of
    several values of one field the least counts."""
    once = values.groupBy("entry", "field").agg(F.min("value").alias("value"))
    pair = F.when(F.col("value").isNotNull(), F.struct("field", "value"))
    return once.groupBy("entry").agg(F.map_from_entries(F.collect_list(pair)).alias("fields"))
