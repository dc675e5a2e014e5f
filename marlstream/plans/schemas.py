"""Field schemas, coerced values and nested content over the tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.operators import nested, schemas
from marlstream.plans.catalog import register, table

#: every kind, one that isn't known, and none
_KINDS = [*schemas.KINDS, "unheard_of", "", None]
_SOURCES = ("dropdownNumber", "Object", "listInput", "Array", "tagEditor", "text")

_INPUT = f"""
    SELECT p_partkey AS k,
           CASE p_partkey % {len(_KINDS)} {" ".join(f"WHEN {i} THEN {'NULL' if x is None else repr(x)}" for i, x in enumerate(_KINDS))} END AS kind,
           CASE p_partkey % {len(_SOURCES)} {" ".join(f"WHEN {i} THEN {x!r}" for i, x in enumerate(_SOURCES))} END AS source_type,
           CASE p_partkey % 5 WHEN 0 THEN '__' || p_name WHEN 1 THEN '2 ' || p_brand WHEN 2 THEN 'Locale' WHEN 3 THEN 'locale' ELSE p_name END AS uid,
           CASE WHEN p_partkey % 13 > 0 THEN p_name END AS title,
           'x (' || p_brand || '-App)' AS source_field, p_type, p_brand,
           CASE p_partkey % 3 WHEN 1 THEN 'b' WHEN 2 THEN 'true' END AS default_value, CASE WHEN p_partkey % 2 = 0 THEN 'dk' END AS default_key, CASE WHEN p_partkey % 4 > 0 THEN p_type END AS description,
           CASE WHEN p_partkey % 7 = 0 THEN '^[a-z]+"$' END AS regex, CASE WHEN p_partkey % 7 < 2 THEN 'no "such" value' END AS message,
           CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 3 = 1 END AS multiple, CASE WHEN p_partkey % 5 > 0 THEN p_partkey % 5 = 1 END AS mandatory, CASE WHEN p_partkey % 11 > 0 THEN p_partkey % 11 = 1 END AS "unique", p_partkey % 4 = 1 AS non_localizable,
           p_partkey % 8 AS options, p_partkey % 6 AS embedded, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS link_title, CASE WHEN p_partkey % 3 = 0 THEN 'https://x.io/' || p_partkey END AS link_url
    FROM part
"""


def _fields(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("__part")
    rows = spark.sql(_INPUT.replace("FROM part", "FROM __part").replace('"unique"', "`unique`"))
    option = lambda key, value: F.struct(F.lit(key).cast("string").alias("key"), F.lit(value).alias("value"))
    options = (
        F.when(F.col("options") == 0, F.array().cast("array<struct<key:string,value:string>>")).when(F.col("options") == 1, F.array(option("a", "A"), option("b", "B"), option("b", "again")))
        .when(F.col("options") == 2, F.array(option(None, "b"), option(None, "c"))).when(F.col("options") == 3, F.array(option(None, "b"), F.lit(None), option("true", "yes")))
    )
    files = F.lit(schemas.FILES)
    embedded = F.when(F.col("embedded") == 0, F.array().cast("array<string>")).when(F.col("embedded") == 1, F.array(files)).when(F.col("embedded") == 2, F.array(F.lit("Big Page"), files)).when(F.col("embedded") == 3, F.array("p_brand"))
    references = F.when(F.col("k") % 3 > 0, F.array("p_brand", F.lit("page")))
    return rows.withColumns({"options": options, "embedded": embedded, "references": references})


def _apps(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.lower("p_brand").alias("app_uid")).where("title < 'Brand#4'").distinct()


_UID = "regexp_replace(regexp_replace(uid, '[^a-zA-Z0-9_]', '_', 'g'), '^_+', '')"
_FLAT = lambda x: f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({x}, '[ -]', '_', 'g')), '[^a-z0-9_]+', '_', 'g'), '_+', '_', 'g'), '^_', ''), '_$', '')"
_CHECKED = "kind IS NULL OR kind NOT IN ('html', 'global_field', 'app', 'extension')"


@register(
    "field_schemas",
    f"""
    WITH i AS ({_INPUT}),
    a AS (SELECT DISTINCT p_brand AS title, lower(p_brand) AS app_uid FROM part WHERE p_brand < 'Brand#4'),
    f AS (SELECT i.* EXCLUDE (options, embedded), app_uid, coalesce(kind = 'json' AND source_type IN ('Object', 'Array'), false) AS objects, coalesce(kind = 'json' AND source_type NOT IN ('Object', 'Array'), false) AS rich,
            CASE options WHEN 0 THEN [] WHEN 1 THEN [{{'key': 'a', 'value': 'A'}}, {{'key': 'b', 'value': 'B'}}, {{'key': 'b', 'value': 'again'}}] WHEN 2 THEN [{{'key': NULL, 'value': 'b'}}, {{'key': NULL, 'value': 'c'}}] WHEN 3 THEN [{{'key': NULL, 'value': 'b'}}, NULL, {{'key': 'true', 'value': 'yes'}}] END AS options,
            CASE embedded WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['sys_assets'] WHEN 2 THEN ['Big Page', 'sys_assets'] WHEN 3 THEN [p_brand] END AS embedded,
            CASE WHEN k % 3 > 0 THEN [p_brand, 'page'] END AS reference_list,
            lower(CASE WHEN NOT regexp_matches({_UID}, '^[a-zA-Z]') THEN 'field_' || {_UID} WHEN {_UID} IN ('locale', 'publish_details', 'tags') THEN 'cm_' || {_UID} ELSE {_UID} END) AS fixed
          FROM i LEFT JOIN a ON a.title = i.p_brand),
    g AS (SELECT *, CASE WHEN len(options) > 0 THEN list_filter(options, lambda o: o IS NOT NULL) ELSE [{{'key': NULL, 'value': 'NF'}}] END AS choices,
            CASE WHEN len(embedded) > 0 THEN list_transform(embedded, lambda x: {_FLAT("x")}) END AS held, (embedded IS NULL OR len(embedded) = 0 OR embedded = ['sys_assets']) AS only_files FROM f)
    SELECT k, CASE WHEN (kind = 'app' AND app_uid IS NULL) OR (kind = 'extension' AND source_type NOT IN ('listInput', 'tagEditor')) OR coalesce(kind, '') = '' THEN NULL ELSE json(json_merge_patch('{{}}', json_object(
        'data_type', CASE WHEN kind IN ('dropdown', 'radio') AND source_type = 'dropdownNumber' THEN 'number' WHEN kind IN ('number', 'boolean', 'isodate', 'json', 'file', 'link', 'reference', 'global_field') THEN kind WHEN kind IN ('app', 'extension') THEN 'json' ELSE 'text' END,
        'display_name', CASE kind WHEN 'json' THEN coalesce(title, fixed) WHEN 'app' THEN string_split(title, ' ')[1] ELSE title END,
        'uid', fixed,
        'display_type', CASE WHEN kind IN ('dropdown', 'radio', 'checkbox') THEN kind END,
        'enum', CASE WHEN kind IN ('dropdown', 'radio', 'checkbox') THEN json_object('advanced', len(list_filter(choices, lambda o: o.key IS NOT NULL)) > 0, 'choices', list_transform(choices, lambda o: CASE WHEN o.key IS NULL THEN json_object('value', o.value) ELSE json_object('key', o.key, 'value', o.value) END)) END,
        'extension_uid', CASE WHEN objects THEN 'jsonobject_extension' WHEN kind = 'app' THEN app_uid WHEN kind = 'extension' THEN 'list_extension' END,
        'config', CASE WHEN objects OR kind IN ('app', 'extension') THEN json('{{}}') END,
        'extensions', CASE WHEN kind = 'file' THEN json('[]') END,
        'field_metadata', CASE WHEN kind <> 'global_field' THEN json_object(
            'description', CASE WHEN objects OR kind IN ('radio', 'checkbox') THEN coalesce(description, '') WHEN kind NOT IN ('reference', 'app', 'extension', 'unheard_of') THEN '' END,
            'default_value', CASE WHEN kind IN ('single_line_text', 'multi_line_text', 'number') THEN to_json(coalesce(default_value, '')) WHEN kind = 'boolean' THEN to_json(coalesce(default_value = 'true', false)) WHEN rich THEN to_json('')
                WHEN kind = 'dropdown' AND len(options) > 0 THEN to_json(list_filter(options, lambda o: o.key = default_value)[1].value) WHEN kind IN ('dropdown', 'radio', 'checkbox') THEN to_json(default_value)
                WHEN kind = 'link' THEN json_object('title', coalesce(link_title, ''), 'url', coalesce(link_url, '')) WHEN kind = 'isodate' THEN json('{{}}') END,
            'default_key', CASE WHEN kind IN ('radio', 'checkbox') THEN coalesce(default_key, '') END,
            'extension', CASE WHEN objects OR kind IN ('app', 'extension') THEN true END, 'allow_json_rte', CASE WHEN rich THEN true END, 'allow_rich_text', CASE WHEN kind = 'html' THEN true END,
            'embed_entry', CASE WHEN rich THEN held IS NOT NULL WHEN kind = 'html' AND NOT only_files THEN true END,
            'multiline', CASE WHEN kind = 'multi_line_text' THEN true WHEN rich OR kind = 'html' THEN false END, 'markdown', CASE WHEN kind = 'markdown' THEN true END,
            'placeholder', CASE WHEN kind = 'markdown' THEN coalesce(default_value, '') END, 'rich_text_type', CASE WHEN rich OR kind = 'html' THEN 'advanced' WHEN kind = 'file' THEN 'standard' END,
            'options', CASE WHEN rich OR kind = 'html' THEN json('[]') END, 'version', CASE WHEN kind = 'html' THEN 3 END, 'hide_time', CASE WHEN kind = 'isodate' THEN true END,
            'ref_multiple', CASE WHEN kind = 'reference' THEN true END, 'ref_multiple_content_types', CASE WHEN kind = 'reference' OR (kind = 'html' AND NOT only_files) THEN true END, '_default', CASE WHEN kind = 'unheard_of' THEN true END) END,
        'reference_to', CASE WHEN objects THEN ['sys_assets'] WHEN rich THEN ['sys_assets'] || coalesce(held, []) WHEN kind IN ('reference', 'global_field') THEN coalesce(reference_list, []) WHEN kind = 'html' AND NOT only_files THEN held END,
        'format', CASE WHEN {_CHECKED} THEN coalesce(regex, '') END, 'error_messages', CASE WHEN {_CHECKED} THEN json_object('format', coalesce(message, '')) END,
        'multiple', kind = 'checkbox' OR coalesce(multiple, false), 'mandatory', coalesce(mandatory, false), 'unique', coalesce("unique", false),
        'non_localizable', CASE WHEN objects THEN false WHEN kind <> 'global_field' THEN coalesce(non_localizable, false) END)))::VARCHAR END AS schema
    FROM g""",
)
def field_schemas(spark, sf_dir):
    return schemas.field_schemas(_fields(spark, sf_dir), _apps(spark, sf_dir)).select("k", "schema")


_MODE = "(CASE o_custkey % 4 WHEN 0 THEN 'AIR' WHEN 1 THEN 'SHIP' WHEN 2 THEN 'by mail' ELSE 'ROAD' END)"
_CELLS = f"""
    SELECT o_orderkey AS entry, CASE o_orderkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS locale, 'f' || (o_orderkey % 12) AS field,
           CASE o_orderkey % 12 WHEN 0 THEN {_MODE} WHEN 1 THEN 'MAIL' WHEN 2 THEN (o_custkey % 50) || ' pieces' WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN '1' ELSE '0' END
                WHEN 4 THEN CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '202' || (o_custkey % 10) || '0' || (o_custkey % 9 + 1) || '1' || (o_custkey % 8) || 'T010203Z' END
                WHEN 5 THEN '<p><a id="t' || (o_custkey % 7) || '" href="/x/' || o_custkey || '">x</a></p>' WHEN 6 THEN '<img mediaid="{{A-' || (o_custkey % 150) || '}}"/>'
                WHEN 7 THEN '{{N-' || (o_custkey % 40) || '}}|' || '{{N-' || (o_custkey % 7 + 20) || '}}' WHEN 8 THEN NULL WHEN 9 THEN 'say "x"' WHEN 10 THEN {_MODE} ELSE 'none' END AS content
    FROM orders
"""


@register(
    "coerced_values",
    f"""
    WITH c AS ({_CELLS}),
    n AS (SELECT 'n' || n_nationkey AS id, CASE n_regionkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS locale, CASE WHEN n_regionkey < 3 THEN 'page' ELSE 'news' END AS type FROM nation),
    r AS (SELECT entry, locale, u.type, u.place, v.id, v.pos FROM (SELECT *, unnest([{{'type': 'page', 'place': 0}}, {{'type': 'news', 'place': 1}}]) AS u FROM c WHERE field = 'f7'),
          LATERAL (SELECT lower(regexp_replace(x.p, '[-{{}}]', '', 'g')) AS id, x.pos FROM (SELECT unnest([{{'p': string_split(content, '|')[1], 'pos': 0}}, {{'p': string_split(content, '|')[2], 'pos': 1}}]) AS x)) v),
    h AS (SELECT entry, string_agg('{{"uid":"' || r.id || '","_content_type_uid":"' || r.type || '"}}', ',' ORDER BY place, pos) FILTER (WHERE n.id IS NOT NULL) AS refs FROM r LEFT JOIN n ON n.id = r.id AND n.type = r.type AND n.locale = r.locale GROUP BY entry)
    SELECT c.entry, c.field, CASE field
        WHEN 'f0' THEN to_json(CASE content WHEN 'AIR' THEN 'by air' WHEN 'SHIP' THEN 'by ship' ELSE 'by mail' END)::VARCHAR
        WHEN 'f1' THEN '{{"key":"MAIL","value":"by mail"}}'
        WHEN 'f2' THEN regexp_extract(content, '^([0-9]+)', 1)
        WHEN 'f3' THEN CASE WHEN content = '1' THEN 'true' ELSE 'false' END
        WHEN 'f4' THEN CASE WHEN content <> '' THEN '"' || content[1:4] || '-' || content[5:6] || '-' || content[7:8] || 'T01:02:03.000Z"' END
        WHEN 'f5' THEN json_object('title', regexp_extract(content, 'id="([^"]*)"', 1), 'href', regexp_extract(content, 'href="([^"]*)"', 1))::VARCHAR
        WHEN 'f6' THEN CASE WHEN regexp_extract(content, 'A-([0-9]+)', 1)::INTEGER BETWEEN 1 AND 99 THEN '{{"uid":"a' || regexp_extract(content, 'A-([0-9]+)', 1) || '"}}' END
        WHEN 'f7' THEN '[' || coalesce(refs, '') || ']'
        WHEN 'f10' THEN NULL
        ELSE to_json(content)::VARCHAR END AS value
    FROM c LEFT JOIN h ON h.entry = c.entry AND c.field = 'f7' WHERE field <> 'f11'""",
)
def coerced_values(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    cells = spark.sql(_CELLS.replace("FROM orders", "FROM __orders"))
    option = lambda key, value: F.struct(F.lit(key).alias("key"), F.lit(value).alias("value"))
    options = F.array(option("AIR", "by air"), option("SHIP", "by ship"), option("MAIL", "by mail"))
    rows = [("f0", "dropdown", None, False, "MAIL"), ("f1", "dropdown", None, True, None), ("f2", "number", None, None, None), ("f3", "boolean", None, None, None), ("f4", "isodate", None, None, None), ("f5", "link", None, None, None),
            ("f6", "file", None, None, None), ("f7", "reference", ["page", "news"], None, None), ("f8", "text", None, None, None), ("f9", "single_line_text", None, None, None), ("f10", "dropdown", None, None, "")]
    fields = spark.createDataFrame(rows, "field string, kind string, references array<string>, multiple boolean, default_value string")
    none = F.array().cast("array<struct<key:string,value:string>>")
    fields = fields.withColumn("options", F.when(F.col("field").isin("f0", "f1"), options).otherwise(none))
    assets = spark.range(1, 100).select(F.concat(F.lit("A-"), "id").alias("asset"), F.to_json(F.struct(F.concat(F.lit("a"), "id").alias("uid"))).alias("record"))
    nation = table(spark, sf_dir, "nation")
    entries = nation.select(F.concat(F.lit("N-"), "n_nationkey").alias("entry"), F.when(F.col("n_regionkey") < 3, "Page").otherwise("News").alias("template"), F.when(F.col("n_regionkey") % 2 == 0, "en").otherwise("de").alias("locale"))
    return schemas.coerced_values(cells, fields, assets, entries)


_RICH = """CASE o_orderkey % 3 WHEN 2 THEN 'plain' ELSE (o_custkey % 50) || '<p><a id="t" href="/x/' || o_custkey || '">x</a></p>' || CASE WHEN o_orderkey % 3 = 1 THEN '<img src="A-' || (o_custkey % 150) || '"/>' ELSE '' END END"""
_TREE = """'{{"attrs":{{}},"children":[{{"text":"' || (o_custkey % 50) || '"}},{{"attrs":{{}},"children":[{{"attrs":{{"href":"/x/' || o_custkey || '","id":"t"}},"children":[{{"text":"x"}}],"type":"a"}}],"type":"p"}}' || {more} || '],"type":"doc"}}'"""


@register(
    "coerced_content",
    f"""SELECT o_orderkey AS entry, CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'J' ELSE 'T' END AS field, CASE o_orderkey % 3
        WHEN 0 THEN '{{"flag":false,"inner":{{"html":' || {_TREE.format(more="''")} || ',"link":{{"title":"t","href":"/x/' || o_custkey || '"}},"up":{{}}}},"none":{{}},"size":' || (o_custkey % 50) || '}}'
        WHEN 1 THEN {_TREE.format(more="""CASE WHEN o_custkey % 150 BETWEEN 1 AND 99 THEN ',{"attrs":{"display-type":"display","href":"A-' || (o_custkey % 150) || '","type":"asset","uid":"a' || (o_custkey % 150) || '"},"children":[{"text":""}],"type":"reference"}' ELSE ',{"attrs":{"src":"A-' || (o_custkey % 150) || '"},"children":[],"type":"img"}' END""")}
        ELSE '"plain"' END AS value FROM orders""",
)
def coerced_content(spark, sf_dir):
    """A global field that holds a number, a flag, nothing, and a group of rich text, a link and another global field that
    holds the first again."""
    cells = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS entry", "'en' AS locale", "CASE o_orderkey % 3 WHEN 0 THEN 'G' WHEN 1 THEN 'J' ELSE 'T' END AS field", f"{_RICH} AS content")
    rows = [("G", "global_field"), ("H", "group"), ("E", "group"), ("U", "global_field"), ("J", "json"), ("T", "app"), ("N", "number"), ("B", "boolean"), ("L", "link")]
    fields = spark.createDataFrame([(*r, None, None, None) for r in rows], "field string, kind string, references array<string>, multiple boolean, default_value string")
    fields = fields.withColumn("options", F.array().cast("array<struct<key:string,value:string>>"))
    held = [("G", "size", "N"), ("G", "flag", "B"), ("G", "none", "E"), ("G", "inner", "H"), ("H", "html", "J"), ("H", "link", "L"), ("H", "up", "U"), ("U", "again", "G"), ("U", "self", "H")]
    assets = spark.range(1, 100).select(F.concat(F.lit("A-"), "id").alias("asset"), F.to_json(F.struct(F.concat(F.lit("a"), "id").alias("uid"))).alias("record"))
    none = spark.createDataFrame([], "entry string, template string, locale string")
    return schemas.coerced_content(cells, fields, assets, none, spark.createDataFrame(held, "owner string, uid string, field string"))


@register(
    "entries_of_values",
    """SELECT entry, string_agg(field || '=' || value, ';' ORDER BY field) AS entry_text FROM (SELECT l_orderkey AS entry, 'f' || l_linenumber AS field, min(CASE WHEN l_returnflag <> 'A' THEN l_returnflag END) AS value FROM lineitem GROUP BY ALL) GROUP BY 1""",
)
def entries_of_values(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("entry"), F.concat(F.lit("f"), "l_linenumber").alias("field"), F.when(F.col("l_returnflag") != "A", F.col("l_returnflag")).alias("value"))
    pairs = F.transform(F.array_sort(F.map_entries("fields")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return schemas.entries(lines).select("entry", F.nullif(F.array_join(pairs, ";"), F.lit("")).alias("entry_text"))


# --- nested content ---------------------------------------------------------------------------------------------


def _nested(spark, sf_dir):
    """Orders as JSON: their lines, each with its flags, and what is known of the customer."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status"))
    item = F.struct(F.col("l_linenumber").alias("no"), "part", F.array("flag", "status").alias("flags"), F.struct(F.when(F.col("part") % 2 == 0, F.col("part")).alias("even")).alias("more"))
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    orders = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("o_orderkey", F.to_json(F.struct(F.struct(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("rank")).alias("customer"), "items", F.array().cast("array<string>").alias("none"))).alias("content"))


_LINES = """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber) - 1 AS i, l_linenumber AS no, part, flag, status, o_custkey, o_orderpriority
    FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY ALL) JOIN orders ON o_orderkey = l_orderkey"""


@register(
    "nested_leaves",
    f"""WITH l AS ({_LINES}) SELECT o_orderkey, 'items[' || i || '].' || x.p AS path, x.v AS value
    FROM (SELECT *, unnest([{{'p': 'no', 'v': no::VARCHAR}}, {{'p': 'part', 'v': part::VARCHAR}}, {{'p': 'flags[0]', 'v': flag}}, {{'p': 'flags[1]', 'v': status}}, {{'p': 'more.even', 'v': CASE WHEN part % 2 = 0 THEN part::VARCHAR END}}]) AS x FROM l) WHERE x.v IS NOT NULL
    UNION ALL SELECT DISTINCT o_orderkey, 'customer.id', o_custkey::VARCHAR FROM l UNION ALL SELECT DISTINCT o_orderkey, 'customer.rank', o_orderpriority FROM l""",
)
def nested_leaves(spark, sf_dir):
    return nested.leaves(_nested(spark, sf_dir), "o_orderkey", "content")


#: a block's field, an array of an array, a place that the target lacks, a field with two targets
_PATHS = [("customer.rank", "header.priority"), ("items[].part", "blocks[].product.uid"), ("items[].flags[]", "blocks[].marks[].text"), ("items[].no", "first_line"), ("customer.id", "header.id"), ("customer.id", "owner")]


@register(
    "project_nested",
    f"""WITH l AS ({_LINES}) SELECT o_orderkey, x.p AS path, x.v AS value
    FROM (SELECT *, unnest([{{'p': 'blocks[' || i || '].product.uid', 'v': part::VARCHAR}}, {{'p': 'blocks[' || i || '].marks[0].text', 'v': flag}}, {{'p': 'blocks[' || i || '].marks[1].text', 'v': status}}]) AS x FROM l)
    UNION ALL SELECT o_orderkey, 'first_line', no::VARCHAR FROM l WHERE i = 0
    UNION ALL SELECT DISTINCT o_orderkey, u, o_custkey::VARCHAR FROM l, (SELECT unnest(['header.id', 'owner']) AS u) UNION ALL SELECT DISTINCT o_orderkey, 'header.priority', o_orderpriority FROM l""",
)
def project_nested(spark, sf_dir):
    return nested.projected_documents(_nested(spark, sf_dir), "o_orderkey", "content", spark.createDataFrame(_PATHS, "source string, target string"))


_BLOCKS_SQL = """SELECT page_id, s[1] AS model, s[2:n] AS path, n FROM (SELECT page_id, s, unnest(range(2, len(s) + 1)) AS n
    FROM (SELECT page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/'), lambda x: x <> '') AS s FROM pages) WHERE len(s) > 1)"""


def _blocks(spark, sf_dir):
    """A block for each segment of a URL, below those before it, in the model of its host."""
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    pages = table(spark, sf_dir, "pages").select("page_id", F.filter(F.split(bare, "/"), lambda x: x != "").alias("s")).where(F.size("s") > 1)
    each = pages.select("page_id", "s", F.explode(F.sequence(F.lit(2), F.size("s"))).alias("n"))
    return each.select("page_id", F.col("s")[0].alias("model"), F.slice("s", F.lit(2), F.col("n") - 1).alias("path"), "n")


@register("merge_blocks_deep", f"SELECT model, array_to_string(path, '/') AS path, count(*) AS n, min(page_id) AS first, arg_min('page ' || page_id, page_id) AS payload FROM ({_BLOCKS_SQL}) GROUP BY model, path")
def merge_blocks_deep(spark, sf_dir):
    blocks = _blocks(spark, sf_dir).withColumn("payload", F.concat(F.lit("page "), "page_id"))
    return nested.merged_blocks(blocks, "model", "path", "page_id", "payload").withColumn("path", F.array_join("path", "/"))


@register(
    "merge_settings_deep",
    f"""SELECT model, array_to_string(path, '/') AS path, string_agg(k || '=' || v, ';' ORDER BY k) FILTER (WHERE v IS NOT NULL) AS settings
    FROM (SELECT model, path, k, arg_min(v, page_id) FILTER (WHERE v IS NOT NULL) AS v FROM (SELECT model, path, page_id, u.k AS k, u.v AS v FROM (SELECT *, unnest([{{'k': 'even', 'v': CASE WHEN page_id % 2 = 0 THEN page_id::VARCHAR END}}, {{'k': 'k' || page_id % 3, 'v': page_id::VARCHAR}}]) AS u FROM ({_BLOCKS_SQL})))
          GROUP BY model, path, k) GROUP BY model, path""",
)
def merge_settings_deep(spark, sf_dir):
    text = F.col("page_id").cast("string")
    blocks = _blocks(spark, sf_dir).withColumn("settings", F.create_map(F.lit("even"), F.when(F.col("page_id") % 2 == 0, text), F.concat(F.lit("k"), F.col("page_id") % 3), text))
    found = nested.merged_settings(blocks, "model", "path", "page_id", "settings")
    pairs = F.transform(F.array_sort(F.map_entries("settings")), lambda x: F.concat(x["key"], F.lit("="), x["value"]))
    return found.select("model", F.array_join("path", "/").alias("path"), F.array_join(pairs, ";").alias("settings"))
