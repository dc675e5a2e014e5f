"""Queries over page models: fields of components of every kind and of templates, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from marlstream.operators import components
from marlstream.plans.catalog import register, table

#: one component of each kind: its type, and what it holds besides an id and a data layer; %K is the part's key, %S its size
_MODELS = [
    ("x/components/navigation/breadcrumb", '"breadcrumbLinkItems":[{"title":"t","path":"p","active":true,"link":{"url":"/x"},"n":1},{"late":"z"}],"not":"me"'),
    ("x/components/title/v2", '"type":"h2",%T"level":%S'),
    ("x/components/textbanner", '"body":%H,"items":[{"h":"<b>y</b>","n":2,"id":"z"}],"bare":["a"],"gone":null'),
    ("x/components/text", '"text":"<p>x</p>","other":1'),
    ("x/components/navigation", '"links":[{"title":"t","target":{"url":"u"},"o":{"x":1}}],"home":{"url":"/"},"plain":{"a":1}'),
    ("x/components/languagenavigation", '"deep":true,"n":%S'),
    ("x/components/separator", '"wide":true'),
    ("x/components/search", '"relativePath":"x","placeholder":"p","big":true,"f":1.5'),
    ("nt:folder", '"title":"t"'),
    ("x/components/heroTeaser", '"pic":"/a/b.jpg","title":"t","actions":[{"title":"t","url":"/u"}],"img2":{"a":"b"},"img3":{"url":"/u"},"more":{"deep":{"x":"y"},"none":{}}'),
    ("x/components/spacer", '"height":%S'),
    ("x/components/customembed", '"type":"%E","embeddableResourceType":"a/embeddable/youtube"'),
    ("x/components/productlisting", '"category":"c","count":%S,"list":[{"a":1}]'),
    ("x/components/button", '"text":"t","linkUrl":"/a/b","icon":"i.png","appliedCssClassNames":"c","to":{"url":"/"}'),
    ("x/components/image", '"src":"/i.png","alt":"no picture","other":"y.png","wide":false'),
    ("x/components/carousel", '"auto":true,":items":{"a":{":type":"x/components/button","text":"t"},"b":{":type":"x/components/button"},"c":{":type":"x/components/spacer"}}'),
]
_ROOT = ":items.root.:items.c"


def _pages(spark, sf_dir):
    """A page for each part, with a component of the kind that its key gives."""
    key, size = F.col("p_partkey"), F.col("p_size")
    made = reduce(lambda found, i: F.when(key % len(_MODELS) == i, F.lit(f'{{":type":"{_MODELS[i][0]}","id":"i","dataLayer":{{"a":"b"}},{_MODELS[i][1]}}}')).otherwise(found), range(len(_MODELS)), F.lit("{}"))
    embeds = F.when(size % 3 == 0, "EMBEDDABLE").when(size % 3 == 1, "HTML").otherwise("OTHER")
    for sign, value in {"%T": F.when(key % 3 == 0, '"text":"x",').otherwise(""), "%H": F.when(size % 2 == 0, '"<p>x</p>"').otherwise('"x"'), "%S": size.cast("string"), "%E": embeds}.items():
        made = F.replace(made, F.lit(sign), value)
    page = F.concat(F.lit('{":type":"x/page",":items":{"root":{":type":"x/components/container",":items":{"c":'), made, F.lit("}}}}"))
    return table(spark, sf_dir, "part").select("p_partkey", page.alias("model"))


#: (kind's number, component below the root, kind, field, uid, type, several, refers, condition)
_FIELDS = [
    (0, "", "breadcrumb", "", "c", "group", False, None, ""), (0, "", "breadcrumb", "title", "title", "single_line_text", False, None, ""), (0, "", "breadcrumb", "active", "active", "boolean", False, None, ""), (0, "", "breadcrumb", "link", "link", "link", False, None, ""),
    (1, "", "title", "", "c", "group", False, None, ""), (1, "", "title", "type", "type", "single_line_text", False, None, ""), (1, "", "title", "level", "level", "number", False, None, ""), (1, "", "title", "text", "text", "single_line_text", False, None, ""),
    (2, "", "textbanner", "", "c", "group", False, None, ""), (2, "", "textbanner", "body", "body", "json", False, None, "p_size % 2 = 0"), (2, "", "textbanner", "body", "body", "single_line_text", False, None, "p_size % 2 = 1"),
    (2, "", "textbanner", "items", "items", "group", True, None, ""), (2, "", "textbanner", "items.h", "h", "json", False, None, ""), (2, "", "textbanner", "items.n", "n", "number", False, None, ""),
    (3, "", "text", "", "text", "json", False, None, ""),
    (4, "", "navigation", "", "c", "group", False, None, ""), (4, "", "navigation", "links", "links", "group", True, None, ""), (4, "", "navigation", "links.title", "title", "single_line_text", False, None, ""), (4, "", "navigation", "links.target", "target", "link", False, None, ""), (4, "", "navigation", "home", "home", "link", False, None, ""),
    (5, "", "languagenavigation", "", "c", "group", False, None, ""), (5, "", "languagenavigation", "deep", "deep", "boolean", False, None, ""), (5, "", "languagenavigation", "n", "n", "number", False, None, ""),
    (6, "", "separator", "", "c", "boolean", False, None, ""),
    (7, "", "search", "", "c", "group", False, None, ""), (7, "", "search", "placeholder", "placeholder", "single_line_text", False, None, ""), (7, "", "search", "big", "big", "boolean", False, None, ""),
    (8, "", "folder", "", "c", "reference", False, None, ""),
    (9, "", "teaser", "", "c", "group", False, None, ""), (9, "", "teaser", "pic", "pic", "file", False, None, ""), (9, "", "teaser", "title", "title", "single_line_text", False, None, ""), (9, "", "teaser", "actions", "actions", "group", True, None, ""), (9, "", "teaser", "actions.title", "title", "single_line_text", False, None, ""),
    (9, "", "teaser", "actions.url", "url", "single_line_text", False, None, ""), (9, "", "teaser", "img3", "img3", "single_line_text", False, None, ""), (9, "", "teaser", "more", "more", "group", False, None, ""), (9, "", "teaser", "more.deep", "deep", "group", False, None, ""), (9, "", "teaser", "more.deep.x", "x", "single_line_text", False, None, ""),
    (10, "", "spacer", "", "c", "group", False, None, ""), (10, "", "spacer", "height", "height", "number", False, None, ""),
    (11, "", "customembed", "", "c (Youtube-App)", "app", False, None, "p_size % 3 = 0"), (11, "", "customembed", "", "c (Html-App)", "app", False, None, "p_size % 3 = 1"),
    (12, "", "productlisting", "", "c", "group", False, None, ""), (12, "", "productlisting", "category", "category", "single_line_text", False, None, ""), (12, "", "productlisting", "count", "count", "number", False, None, ""),
    (13, "", "button", "", "c", "group", False, None, ""), (13, "", "button", "text", "text", "single_line_text", False, None, ""), (13, "", "button", "linkUrl", "linkUrl", "link", False, None, ""), (13, "", "button", "icon", "icon", "file", False, None, ""), (13, "", "button", "to", "to", "link", False, None, ""),
    (14, "", "image", "", "c", "group", False, None, ""), (14, "", "image", "src", "src", "file", False, None, ""), (14, "", "image", "alt", "alt", "single_line_text", False, None, ""), (14, "", "image", "other", "other", "single_line_text", False, None, ""), (14, "", "image", "wide", "wide", "boolean", False, None, ""),
    (15, "", "carousel", "", "c", "group", False, None, ""), (15, "", "carousel", "auto", "auto", "boolean", False, None, ""), (15, "", "carousel", ":items", ":items", "group", False, None, ""),
    (15, "", "carousel", ":items.button", "button", "group", True, "x/components/button", ""), (15, "", "carousel", ":items.spacer", "spacer", "group", True, "x/components/spacer", ""),
    (15, ".:items.a", "button", "", "a", "group", False, None, ""), (15, ".:items.a", "button", "text", "text", "single_line_text", False, None, ""), (15, ".:items.b", "button", "", "b", "group", False, None, ""), (15, ".:items.c", "spacer", "", "c", "group", False, None, ""),
]


def _fields_sql() -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    parts = [
        f"SELECT p_partkey, {text(_ROOT + at)} AS component, {text(kind)} AS kind, {text(field)} AS field, {text(uid)} AS uid, {text(made)} AS field_type, {several} AS multiple, {text(refers)}::VARCHAR AS refers FROM part WHERE p_partkey % {len(_MODELS)} = {number} {'AND ' + only if only else ''}"
        for number, at, kind, field, uid, made, several, refers, only in _FIELDS
    ]
    return " UNION ALL ".join(parts)


@register("component_fields", _fields_sql())
def component_fields(spark, sf_dir):
    return components.fields(components.opened(_pages(spark, sf_dir), "p_partkey", "model"), "p_partkey")


def _templates(spark, sf_dir):
    """A template for each customer: nested containers, fragments, and components of known and unknown kinds."""
    key, account = F.col("c_custkey"), F.col("c_nationkey")
    inner = F.when(account % 2 == 0, '"d":{":type":"x/components/container",":items":{"e":{":type":"x/components/text"},"f":{":type":"x/unknown",":items":{"g":{":type":"x/components/text"}}}}}').otherwise('"d":{":type":"x/components/separator"}')
    parts = F.concat_ws(",", F.lit('"a":{":type":"x/components/button","text":"t"},"b":{":type":"x/unknown"}'), F.concat(F.lit('"c":{":type":"x/responsivegrid",":items":{'), inner, F.lit(',"h":{":type":"x/experiencefragment","fragmentVariationPath":"/content/xf/head-'), key % 3, F.lit('/master"}}}')))
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit('{":items":{"root":{":type":"x/components/container",":items":{'), parts, F.lit("}}}}")).alias("model"))


@register(
    "template_fields",
    """SELECT c_custkey, u.* FROM customer, LATERAL (SELECT unnest([{'path': 'a', 'field': 'a', 'field_type': 'group', 'is_block': false, 'refers': 'x/components/button'}, {'path': 'c', 'field': 'c', 'field_type': 'modular_blocks', 'is_block': false, 'refers': NULL},
           {'path': 'c/h', 'field': 'h', 'field_type': 'reference', 'is_block': true, 'refers': 'head-' || c_custkey % 3}], recursive := true)) AS u
       UNION ALL SELECT c_custkey, 'c/d', 'd', 'boolean', true, 'x/components/separator' FROM customer WHERE c_nationkey % 2 = 1
       UNION ALL SELECT c_custkey, 'c/d', 'd', 'modular_blocks', true, NULL FROM customer WHERE c_nationkey % 2 = 0
       UNION ALL SELECT c_custkey, 'c/d/e', 'e', 'json', true, 'x/components/text' FROM customer WHERE c_nationkey % 2 = 0""",
)
def template_fields(spark, sf_dir):
    return components.template_fields(components.opened(_templates(spark, sf_dir), "c_custkey", "model"), "c_custkey")
