"""Field lists of page components, inferred from page models by builder tables.

A page model is opened to a row for each node; a component is an object with a `:type`. Its kind says by a table which of its
properties become fields of which type, and which are opened further: a level of all components of all pages at a time.
What a template holds is told by reference: a field that is another component or a shared fragment names it, and its
fields stay where they are, once; so fragments that hold one another need no end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import text
from marlstream.operators import blocks
from marlstream.operators.classify import first_rule
from marlstream.session import dropped, stored

#: fixed values: (kind, parts of a component's type of which any makes it that kind), in order of precedence
KINDS = (
    ("breadcrumb", ("components/navigation/breadcrumb",)),
    ("title", ("/components/title",)),
    ("textbanner", ("/components/textbanner",)),
    ("text", ("/components/text", "/components/richText")),
    ("navigation", ("/components/navigation",)),
    ("languagenavigation", ("/components/languagenavigation",)),
    ("separator", ("/components/separator",)),
    ("search", ("/components/search",)),
    ("folder", ("nt:folder",)),
    ("teaser", ("/components/teaser", "/components/heroTeaser", "/components/overlayBoxTeaser", "/productCategoryTeaserList")),
    ("spacer", ("/components/spacer",)),
    ("customembed", ("/components/customembed",)),
    ("productlisting", ("/components/productlisting", "/components/productTeaserListConfiguredProducts", "/components/productTeaserListConfiguredCategory")),
    ("button", ("/components/button",)),
    ("image", ("/components/image",)),
    ("carousel", ("/components/carousel",)),
)

#: fixed values: properties that never become fields, of every kind and of some
EXCLUDED = ("dataLayer", ":type", "id")
EXCLUDED_OF = {
    "breadcrumb": ("path",),
    "navigation": ("path",),
    "languagenavigation": ("path",),
    "search": ("relativePath", "searchRootPagePath"),
    "spacer": ("relativePath",),
    "productlisting": ("relativePath",),
    "button": ("path", "appliedCssClassNames"),
    "image": ("srcUriTemplate",),
    "carousel": (":itemsOrder",),
}

#: fixed values: the field that a component of a kind is itself; customembed depends on what it embeds
OWN_TYPES = {"text": "json", "separator": "boolean", "folder": "reference", "customembed": "app"}
_PLAIN = {("string", ""): "single_line_text", ("boolean", ""): "boolean", ("integer", ""): "number"}
_LISTS = {("object", "url"): "link", ("array", "items"): "group*"}
#: fixed values: (shape of a property, trait) -> field type by kind; the first trait that a property has and a table knows
#: decides. A * marks a field with several values; groups are opened.
BUILDERS = {
    "breadcrumb": {("string", ""): "single_line_text", ("boolean", ""): "boolean", **_LISTS},
    "title": _PLAIN,
    "textbanner": {**_PLAIN, ("string", "html"): "json", ("array", "items"): "group*"},
    "navigation": {**_PLAIN, **_LISTS},
    "languagenavigation": {**_PLAIN, **_LISTS},
    "search": _PLAIN,
    "teaser": {**_PLAIN, ("string", "image"): "file", ("object", ""): "group", ("array", "items"): "group*"},
    "spacer": _PLAIN,
    "productlisting": _PLAIN,
    "button": {**_PLAIN, ("string", "url"): "link", ("string", "image"): "file", ("object", "url"): "link"},
    "image": {**_PLAIN, ("string", "image"): "file"},
    "carousel": {**_PLAIN, ("object", ""): "group"},
}
TRAITS = ("url", "image", "html", "items", "")
#: fixed values: the properties of an image component that hold pictures
_PICTURES = ("alt", "src", "link")


def component_kind(kind: Column, heading: Column) -> Column:
    def holds(name, parts):
        found = reduce(Column.__or__, [F.contains(kind, F.lit(p)) for p in parts])
        return F.coalesce(found & heading.rlike("^h[1-6]$") if name == "title" else found, F.lit(False))

    return first_rule([(holds(name, parts), name) for name, parts in KINDS])


def opened(pages: DataFrame, key: str, column: str) -> DataFrame:
    """All nodes of page models (key, path, parent, name, at, depth, kind, json), stored."""
    return stored(blocks.nodes(pages, [key], column))


def _string(json: Column) -> Column:
    return F.when(F.startswith(json, F.lit('"')), F.from_json(F.concat(F.lit('{"v":'), json, F.lit("}")), "v string")["v"])


def components(tree: DataFrame, key: str) -> DataFrame:
    """(key, component, type, kind, embeds) of the components of opened page models; component is a path."""
    asked = (":type", "type", "embeddableResourceType")
    named = tree.where(F.col("name").isin(*asked) & (F.col("kind") == "value") & F.col("parent").isNotNull())
    values = [F.max(F.when(F.col("name") == n, _string(F.col("json")))).alias(c) for n, c in zip(asked, ("type", "heading", "resource"), strict=True)]
    found = named.groupBy(key, F.col("parent").alias("component")).agg(*values).where("type IS NOT NULL")
    app = F.when((F.col("heading") == "EMBEDDABLE") & F.contains("resource", F.lit("/embeddable/youtube")), "Youtube").when(F.col("heading") == "HTML", "Html").when(F.col("heading") == "URL", "Url")
    return found.select(key, "component", "type", component_kind(F.col("type"), F.col("heading")).alias("kind"), app.alias("embeds"))


def _shape(kind: Column, json: Column) -> Column:
    value = F.when(F.startswith(json, F.lit('"')), "string").when(json.isin("true", "false"), "boolean").when(json.rlike(r"^-?\d+$"), "integer")
    return F.when(kind == "value", value).otherwise(kind)


def _table() -> Column:
    return F.create_map(*[F.lit(x) for kind, rules in BUILDERS.items() for (shape, trait), made in rules.items() for x in (f"{kind}|{shape}|{trait}", made)])


def _properties(tree: DataFrame, key: str) -> DataFrame:
    """(key, parent, path, name, shape, url, image, html, items): nodes as properties of what holds them."""
    own = tree.select(key, "parent", "path", "name", _shape(F.col("kind"), F.col("json")).alias("shape"), _string(F.col("json")).alias("value"))
    # an object with a url, an array whose first element is an object with anything in it
    inner = tree.where((F.col("name") == "url") & (F.col("kind") != "null")).select(key, F.col("parent").alias("path"), F.lit(True).alias("has_url"))
    first = tree.where(F.endswith("path", F.lit("[0]")) & (F.col("kind") == "object") & (F.col("json") != "{}")).select(key, F.col("parent").alias("path"), F.lit(True).alias("has_items"))
    both = own.join(inner, [key, "path"], "left").join(first, [key, "path"], "left")
    url = F.when(F.col("shape") == "string", text.is_path(F.col("value"))).otherwise(F.col("has_url"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    return both.select(key, "parent", "path", "name", "shape", yes(url).alias("url"), yes(text.is_image(F.col("value"))).alias("image"), yes(text.is_html(F.col("value"))).alias("html"), yes(F.col("has_items")).alias("items"))


def fields(tree: DataFrame, key: str) -> DataFrame:
    """(key, component, kind, field, uid, field_type, multiple, refers): the fields of all components.

    field is the path in the component, empty for what the component is itself. refers names the type of a component that
    is held, whose fields are that component's. A breadcrumb has the fields of its first link; a title without title or
    text gets a text; an embedded item is named after what it embeds, and is no field if that is unknown. A group of a teaser without fields
    is a text if it has a url and else none. Stored.
    """
    found = stored(components(tree, key).where("kind IS NOT NULL"))
    properties = stored(_properties(tree, key))
    here = [key, "component", "kind"]
    own_type = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in OWN_TYPES.items()], F.lit("group"))
    uid = F.substring_index(F.regexp_replace("component", r"\[\d+\]$", ""), ".", -1)
    top = found.where((F.col("kind") != "customembed") | F.col("embeds").isNotNull()).select(
        *here, F.lit("").alias("field"), F.when(F.col("kind") == "customembed", F.concat(uid, F.lit(" ("), "embeds", F.lit("-App)"))).when(F.col("kind") == "text", F.lit("text")).otherwise(uid).alias("uid"),
        own_type.alias("field_type"), F.lit(False).alias("multiple"), F.lit(None).cast("string").alias("refers"),
    )
    excluded = F.col("name").isin(*EXCLUDED)
    for kind, names in EXCLUDED_OF.items():
        excluded = excluded | ((F.col("kind") == kind) & F.col("name").isin(*names))
    table = _table()
    rule = lambda t: F.element_at(table, F.concat_ws("|", "kind", "shape", F.lit(t)))
    # pictures of an image component are in three of its properties
    has = {t: F.col(t) if t else F.lit(True) for t in TRAITS}
    has["image"] = F.col("image") & ((F.col("kind") != "image") | F.col("name").isin(*_PICTURES))
    made = F.coalesce(*[F.when(has[t], rule(t)) for t in TRAITS])
    # the first level: a breadcrumb's is that of its first link
    start = F.when(F.col("kind") == "breadcrumb", F.concat_ws(".", F.nullif("component", F.lit("")), F.lit("breadcrumbLinkItems[0]"))).otherwise(F.col("component"))
    level = found.where(F.col("kind").isin(*BUILDERS)).select(*here, start.alias("__at"), F.lit("").alias("above"))
    levels = []
    while True:
        held = level.alias("l").join(properties.alias("p"), (F.col(f"l.{key}") == F.col(f"p.{key}")) & (F.col("l.__at") == F.col("p.parent")))
        each = held.select(*[F.col(f"l.{c}") for c in here], F.col("l.above"), *[F.col(f"p.{c}") for c in ("path", "name", "shape", "url", "image", "html", "items")]).where(~excluded)
        rows = each.withColumn("made", made).where("made IS NOT NULL")
        now = stored(rows.select(*here, "above", "path", "name", "url", "shape", F.concat_ws(".", F.nullif("above", F.lit("")), "name").alias("field"), F.replace("made", F.lit("*"), F.lit("")).alias("field_type"), F.endswith("made", F.lit("*")).alias("multiple")))
        if now.isEmpty():
            dropped(now)
            break
        levels.append(now)
        inner = now.where((F.col("field_type") == "group") & ((F.col("kind") != "carousel")))
        level = inner.select(*here, F.when(F.col("shape") == "array", F.concat("path", F.lit("[0]"))).otherwise(F.col("path")).alias("__at"), F.col("field").alias("above"))
    done, below = [], None
    for now in reversed(levels):
        if below is not None:
            full = below.select(*here, F.col("above").alias("field"), F.lit(True).alias("full")).distinct()
            now = now.join(full, [*here, "field"], "left")
        else:
            now = now.withColumn("full", F.lit(None).cast("boolean"))
        bare = (F.col("kind") == "teaser") & (F.col("field_type") == "group") & (F.col("full").isNull() | ((F.col("shape") == "object") & F.col("name").rlike(r"\d")))
        kept = now.withColumn("bare", bare).where(~F.col("bare") | ((F.col("shape") == "object") & F.col("url")))
        below = stored(kept.withColumn("field_type", F.when(F.col("bare"), "single_line_text").otherwise(F.col("field_type"))))
        done.append(below)
    columns = ["field", "uid", "field_type", "multiple", "refers"]
    parts = [top.select(*here, *columns)]
    for d in done:
        parts.append(d.select(*here, "field", F.col("name").alias("uid"), "field_type", "multiple", F.lit(None).cast("string").alias("refers")))
    every = reduce(DataFrame.unionByName, parts)
    # fields below a group that became a text, or went, go with it
    groups = every.where("field_type = 'group'").select(*here, F.col("field").alias("__group"))
    above = F.when(F.contains("field", F.lit(".")), F.regexp_replace("field", r"\.[^.]*$", "")).otherwise(F.lit(""))
    named = every.withColumn("__group", above)
    every = named.where("field = ''").unionByName(named.where("field <> ''").join(groups, [*here, "__group"], "left_semi").select(named.columns)).drop("__group")
    titles = every.where("kind = 'title'").groupBy(*here).agg(F.max(F.col("field").isin("title", "text")).alias("has"))
    texts = titles.where("NOT has").select(*here, F.lit("text").alias("field"), F.lit("text").alias("uid"), F.lit("single_line_text").alias("field_type"), F.lit(False).alias("multiple"), F.lit(None).cast("string").alias("refers"))
    # what a carousel holds, once for each type
    items = found.where("kind = 'carousel'").select(*here, F.concat_ws(".", F.nullif("component", F.lit("")), F.lit(":items")).alias("__at"))
    slides = items.join(found.select(key, F.col("component").alias("__slide"), F.col("type").alias("refers"), F.col("kind").alias("slide")), key).where(F.regexp_replace("__slide", r"\.[^.]*$", "") == F.col("__at"))
    slides = slides.select(*here, F.concat(F.lit(":items."), "slide").alias("field"), F.col("slide").alias("uid"), F.coalesce(*[F.when(F.col("slide") == k, F.lit(t)) for k, t in OWN_TYPES.items()], F.lit("group")).alias("field_type"), F.lit(True).alias("multiple"), "refers").distinct()
    result = stored(every.unionByName(texts).unionByName(slides))
    dropped(found, properties, *levels, *done)
    return result


def template_fields(tree: DataFrame, key: str, root: str = ":items.root") -> DataFrame:
    """(key, path, field, field_type, is_block, refers) of the items below a template's root, at any depth: a container is
    modular_blocks and its items are the blocks; a fragment is a reference to it by the last part of its path; any
    other component is what it is and refers to its type, if its kind is known; what it holds is its own."""
    found = components(tree, key)
    fragment = tree.where(F.col("name") == "fragmentVariationPath").select(key, F.col("parent").alias("component"), _string(F.col("json")).alias("fragment"))
    below = found.where(F.startswith("component", F.lit(f"{root}.:items."))).join(fragment, [key, "component"], "left")
    steps = F.split(F.substring("component", len(root) + 2, 1 << 30), r"\.?:items\.")
    names = F.filter(steps, lambda x: x != "")
    shared = F.contains("type", F.lit("/experiencefragment"))
    container = F.contains("type", F.lit("/container")) | F.contains("type", F.lit("/responsivegrid"))
    kind = F.when(shared, "reference").when(container, "modular_blocks").when(F.col("kind").isNotNull(), F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in OWN_TYPES.items()], F.lit("group")))
    refers = F.when(shared, F.element_at(F.filter(F.split("fragment", "/"), lambda x: x != ""), -2)).when(~container, F.col("type"))
    rows = below.select(key, "component", names.alias("names"), kind.alias("field_type"), refers.alias("refers"), container.alias("holds")).where("field_type IS NOT NULL")
    # only containers are looked into
    paths = rows.withColumn("above", F.array_join(F.slice("names", F.lit(1), F.size("names") - 1), "/")).withColumn("path", F.array_join("names", "/"))
    now, done = paths.where("above = ''"), []
    while True:
        now = stored(now)
        if now.isEmpty():
            dropped(now)
            break
        done.append(now)
        inside = now.where("holds").select(key, F.col("path").alias("above"))
        now = paths.join(inside, [key, "above"], "left_semi").select(paths.columns)
    every = reduce(DataFrame.unionByName, done) if done else paths.where(F.lit(False))
    return every.select(key, "path", F.element_at("names", -1).alias("field"), "field_type", (F.col("above") != "").alias("is_block"), "refers")
