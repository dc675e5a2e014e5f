"""One query for each of many small operators over the tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.functions import text as X
from marlstream.functions import values as V
from marlstream.operators import classify, lookup, mapping, merge, metadata
from marlstream.plans.catalog import register, table

# --- joins ------------------------------------------------------------------------------------------------------


@register("mapping_first_match", "SELECT l_orderkey, f.p_partkey, f.p_name FROM (SELECT l_orderkey, 'Brand#' || (10 + l_partkey % 60) AS b FROM lineitem) LEFT JOIN (SELECT p_brand, min(p_partkey) AS p_partkey, arg_min(p_name, p_partkey) AS p_name FROM part WHERE p_size > 3 GROUP BY 1) f ON b = p_brand")
def mapping_first_match(spark, sf_dir):
    """A cell's field is the first mapping of its key; cells without one stay."""
    cells = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("Brand#"), 10 + F.col("l_partkey") % 60).alias("p_brand"))
    first = lookup.first_match(table(spark, sf_dir, "part").where("p_size > 3").select("p_brand", "p_partkey", "p_name"), ["p_brand"], ["p_partkey"])
    return cells.join(first, "p_brand", "left").select("l_orderkey", "p_partkey", "p_name")


@register("entry_content_type", "SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN 'alert' WHEN '5-LOW' THEN 'note' END, o_orderpriority) AS content_type FROM orders")
def entry_content_type(spark, sf_dir):
    keys = F.create_map(F.lit("1-URGENT"), F.lit("alert"), F.lit("5-LOW"), F.lit("note"))
    return table(spark, sf_dir, "orders").select("o_orderkey", mapping.selected(keys, F.col("o_orderpriority")).alias("content_type"))


@register("component_by_type", "SELECT e.event_id, c.event_type AS component FROM events e LEFT JOIN (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error') c USING (event_type)")
def component_by_type(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("type"))
    known = events.select("type").distinct().where("type != 'error'").withColumn("component", F.col("type"))
    return events.join(known, "type", "left").select("event_id", "component")


@register("app_by_title", "SELECT p_partkey, n_nationkey AS app FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'x (NATION_' || p_size || '-App)' WHEN 1 THEN 'NATION_' || p_size ELSE 'y' END AS f, CASE WHEN p_partkey % 3 < 2 THEN 'NATION_' || p_size ELSE 'y' END AS t FROM part) LEFT JOIN (SELECT n_nationkey, 'NATION_' || n_nationkey AS n FROM nation) ON n = t")
def app_by_title(spark, sf_dir):
    size = F.col("p_size").cast("string")
    field = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x (NATION_"), size, F.lit("-App)"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("NATION_"), size)).otherwise(F.lit("y"))
    apps = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("app"), F.concat(F.lit("NATION_"), "n_nationkey").alias("title"))
    return table(spark, sf_dir, "part").select("p_partkey", X.app_name(field).alias("title")).join(apps, "title", "left").select("p_partkey", "app")


@register("extension_locations", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2")
def extension_locations(spark, sf_dir):
    places = table(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey").join(places, "s_nationkey").select("s_suppkey", "n_name")


@register("asset_by_path_suffix", "SELECT p.page_id, min(d.page_id) AS asset FROM (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?].*$', ''), '^https?://[^/]+', '') AS path FROM pages) p JOIN (SELECT page_id, regexp_replace(regexp_replace(trim(url), '[?].*$', ''), '^https?://[^/]+', '') AS path FROM pages) d USING (path) GROUP BY 1")
def asset_by_path_suffix(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", X.asset_path(F.col("url")).alias("path"))
    return pages.join(pages.groupBy("path").agg(F.min("page_id").alias("asset")), "path").select("page_id", "asset")


@register("keys_minus", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def keys_minus(spark, sf_dir):
    return merge.minus(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@register("keys_intersect", "SELECT c_nationkey AS nation FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0")
def keys_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


# --- projections ------------------------------------------------------------------------------------------------


@register("term_records", "SELECT 'nation_' || n_nationkey AS uid, n_name AS title, lower(n_name) AS slug, '' AS description FROM nation")
def term_records(spark, sf_dir):
    """A fixed projection with new names."""
    return table(spark, sf_dir, "nation").select(F.concat(F.lit("nation_"), "n_nationkey").alias("uid"), F.col("n_name").alias("title"), F.lower("n_name").alias("slug"), F.lit("").alias("description"))


_RULES = [
    mapping.Mapping("o_orderkey", "uid", "single_line_text"), mapping.Mapping("o_totalprice", "total", "number"), mapping.Mapping("o_orderstatus", "status", "dropdown", options=(("F", "final"), ("O", "open")), default="other"),
    mapping.Mapping("flag", "urgent", "boolean"), mapping.Mapping("o_orderpriority", "tags", "text", multiple=True), mapping.Mapping("absent", "nothing", "text"),
]


@register("mapped_entries", "SELECT o_orderkey::VARCHAR AS uid, floor(o_totalprice)::BIGINT AS total, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' ELSE 'other' END AS status, o_orderkey % 3 = 1 AS urgent, [o_orderpriority] AS tags, NULL::VARCHAR AS nothing FROM orders")
def mapped_entries(spark, sf_dir):
    """A mapping, compiled to one projection."""
    orders = table(spark, sf_dir, "orders").withColumn("flag", F.element_at(F.array(F.lit("no"), F.lit("yes"), F.lit("0")), (F.col("o_orderkey") % 3 + 1).cast("int"))).withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)"))
    return mapping.projected(orders, _RULES)


@register("mapped_json", "SELECT event_id, (props->>'$.k')::BIGINT AS k, NULL::VARCHAR AS deep FROM events")
def mapped_json(spark, sf_dir):
    rules = [mapping.Mapping("k", "k", "number"), mapping.Mapping("a.b.c", "deep", "text")]
    return mapping.projected_json(table(spark, sf_dir, "events"), "props", rules, ["event_id"])


def _types_sql(column: str, types: dict, default: str = "reference") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.items()) + f" ELSE '{default}' END"


_ITEMS = list(mapping.ITEM_TYPES) + ["unheard of"]


@register("item_types", "SELECT p_partkey, " + _types_sql(f"list_extract({_ITEMS}, (p_partkey % {len(_ITEMS)} + 1)::INTEGER)", mapping.ITEM_TYPES) + " AS kind FROM part")
def item_types(spark, sf_dir):
    source = F.element_at(F.array(*[F.lit(x) for x in _ITEMS]), (F.col("p_partkey") % len(_ITEMS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", mapping.mapped_type(source, mapping.ITEM_TYPES).alias("kind"))


_PAIRS = [*mapping.SECTION_TYPES, ("Symbol", "unheard of"), ("Unheard", "of")]
_PAIRS_SQL = "CASE p_partkey % {} ".format(len(_PAIRS)) + " ".join(f"WHEN {i} THEN '{mapping.SECTION_TYPES.get(p, mapping.SECTION_TYPES.get((p[0], ''), 'reference'))}'" for i, p in enumerate(_PAIRS)) + " END"


@register("section_types", f"SELECT p_partkey, {_PAIRS_SQL} AS kind FROM part")
def section_types(spark, sf_dir):
    """Types by a pair of type and widget, then by type alone."""
    pick = lambda i: F.element_at(F.array(*[F.lit(p[i]) for p in _PAIRS]), (F.col("p_partkey") % len(_PAIRS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", mapping.mapped_type(pick(0), mapping.SECTION_TYPES, pick(1)).alias("kind"))


@register("inferred_types", "SELECT event_id, " + _types_sql("CASE event_id % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'object' ELSE 'boolean' END", mapping.INFERRED_TYPES) + " AS kind FROM events")
def inferred_types(spark, sf_dir):
    source = F.element_at(F.array(*[F.lit(x) for x in ("string", "integer", "object", "boolean")]), (F.col("event_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", mapping.mapped_type(source, mapping.INFERRED_TYPES).alias("kind"))


@register("dropped_keys", "SELECT n_nationkey, array_to_string(list_sort(['name=' || n_name, 'region=' || n_regionkey]), ';') AS kept FROM nation")
def dropped_keys(spark, sf_dir):
    entry = F.create_map(F.lit("name"), "n_name", F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("blocks"), F.lit("x"), F.lit("schema"), F.lit("y"))
    pairs = V.key_values(V.without_keys(entry, ["blocks", "schema"]))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit("="), x["value"])), ";").alias("kept"))


@register("media_objects", "SELECT n_regionkey, string_agg(n_nationkey || ':' || n_name, ',' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 > 0) AS media FROM nation GROUP BY 1")
def media_objects(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", F.when(F.col("n_nationkey") % 3 > 0, F.lit("id")).alias("public_id"), "n_name", F.lit(1).alias("more")))).alias("objects"))
    kept = V.projected_objects(F.col("objects"), "public_id", ["n_nationkey", "n_name"])
    return nation.select("n_regionkey", F.nullif(F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["n_nationkey"], x["n_name"])), ","), F.lit("")).alias("media"))


@register("row_uid", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ab-' || p_partkey ELSE sha256(p_name) END AS uid FROM part")
def row_uid(spark, sf_dir):
    given = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("{AB-"), "p_partkey", F.lit("}"))).when(F.col("p_partkey") % 4 == 2, F.concat(F.lit("Ab-"), "p_partkey")).when(F.col("p_partkey") % 4 == 1, "{}")
    return table(spark, sf_dir, "part").select("p_partkey", V.row_id(given, F.col("p_name")).alias("uid"))


@register("initial_copies", "SELECT n_nationkey, n_name, n_name AS initial FROM nation")
def initial_copies(spark, sf_dir):
    return metadata.with_initial(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name")


@register("apps_of_extensions", "SELECT n_regionkey, string_agg(n, ',' ORDER BY n) AS extensions FROM (SELECT DISTINCT n_regionkey, substr(n_name, 1, 1) AS n FROM nation) GROUP BY 1")
def apps_of_extensions(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set(F.substring("n_name", 1, 1))), ",").alias("extensions"))


@register("parent_references", "SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN '' ELSE 'r_' || n_regionkey || '/pages' END AS parent FROM nation")
def parent_references(spark, sf_dir):
    parent = F.when(F.col("n_regionkey") == 0, F.lit("0")).otherwise(F.concat(F.lit("r_"), "n_regionkey"))
    found = V.references(F.array(parent, F.lit("")), "pages")
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(found, lambda x: F.concat_ws("/", x["uid"], x["_content_type_uid"])), ",").alias("parent"))


# --- texts and values -------------------------------------------------------------------------------------------


@register(
    "file_names",
    r"""SELECT page_id, regexp_extract(u, '[^/]*$', 0) AS name, regexp_replace(regexp_extract(u, '[^/]*$', 0), '\.[^.]*$', '') AS stem, regexp_extract(regexp_extract(u, '[^/]*$', 0), '\.([^.]*)$', 1) AS ending,
        regexp_matches(u, '(?i)\.(jpeg|jpg|png|gif|webp|svg)$') AS image, regexp_replace(u, '[^a-zA-Z0-9_.\s-]', '', 'g') AS safe
    FROM (SELECT page_id, url || CASE page_id % 3 WHEN 0 THEN '/a b.PNG' WHEN 1 THEN '/x.tar.gz' ELSE '' END AS u FROM pages)""",
)
def file_names(spark, sf_dir):
    url = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/a b.PNG").when(F.col("page_id") % 3 == 1, "/x.tar.gz").otherwise(""))
    name = X.file_name(url)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name"), X.without_extension(name).alias("stem"), X.extension(name).alias("ending"), X.is_image(url).alias("image"), X.safe_file_name(url).alias("safe"))


@register("path_and_html_tests", "SELECT page_id, starts_with(x, '/') AS path, regexp_matches(x, '(?s)<[a-zA-Z][^>]*>') AS html FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/' || url WHEN 1 THEN html ELSE '1 < 2' END AS x FROM pages)")
def path_and_html_tests(spark, sf_dir):
    x = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/"), "url")).when(F.col("page_id") % 3 == 1, F.col("html")).otherwise(F.lit("1 < 2"))
    return table(spark, sf_dir, "pages").select("page_id", X.is_path(x).alias("path"), X.is_html(x).alias("html"))


@register("last_segments", "SELECT p_partkey, list_extract(string_split_regex(x, '[.>/]'), -1) AS last, string_split(x, '.')[1] AS first, trim(list_extract(list_filter(string_split_regex(x, '[.>]'), lambda y: trim(y) <> ''), -1)) AS leaf FROM (SELECT p_partkey, p_brand || CASE p_partkey % 3 WHEN 0 THEN '.' || p_type WHEN 1 THEN ' > ' || p_type || ' > ' ELSE '/' || p_type END AS x FROM part)")
def last_segments(spark, sf_dir):
    x = F.concat("p_brand", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("."), "p_type")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" > "), "p_type", F.lit(" > "))).otherwise(F.concat(F.lit("/"), "p_type")))
    return table(spark, sf_dir, "part").select("p_partkey", X.last_segment(x, "[.>/]").alias("last"), X.first_segment(x, ".").alias("first"), X.clean_leaf(x).alias("leaf"))


@register("editor_comments", "SELECT doc_id, regexp_replace(text || '&lt;!-- wp:image {\"id\":1} --&gt;end', '(?s)&lt;!--?\\s+/?wp:.*?--&gt;', '', 'g') AS body FROM documents")
def editor_comments(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.without_block_comments(F.concat("text", F.lit('&lt;!-- wp:image {"id":1} --&gt;end'))).alias("body"))


@register("display_names", "SELECT p_partkey, CASE WHEN length(p_name) > 25 THEN substr(p_name, 1, 15) || '...' || right(p_name, 8) ELSE p_name END AS short, CASE WHEN b < 1024 THEN b || 'bytes' WHEN b < 1048576 THEN printf('%.1fKB', b / 1024) ELSE printf('%.1fMB', b / 1048576) END AS size FROM (SELECT p_partkey, p_name || ' ' || p_name AS p_name, p_partkey * p_partkey * 7 AS b FROM part)")
def display_names(spark, sf_dir):
    name, size = F.concat_ws(" ", "p_name", "p_name"), F.col("p_partkey") * F.col("p_partkey") * 7
    return table(spark, sf_dir, "part").select("p_partkey", X.short_name(name).alias("short"), X.file_size(size).alias("size"))


@register("numbers_of_texts", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN 2.5 END AS n FROM part")
def numbers_of_texts(spark, sf_dir):
    x = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).when(F.col("p_partkey") % 4 == 1, "2.5").when(F.col("p_partkey") % 4 == 2, "  ").otherwise("12 pieces")
    return table(spark, sf_dir, "part").select("p_partkey", V.number(x).alias("n"))


@register("bytes_of_json", "SELECT n_nationkey, octet_length(encode(json_object('n_name', n_name || 'é', 'n_regionkey', n_regionkey)::VARCHAR))::INTEGER AS b FROM nation")
def bytes_of_json(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", V.json_bytes(F.struct(F.concat("n_name", F.lit("é")).alias("n_name"), "n_regionkey")).alias("b"))


@register("values_as_arrays", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN [] ELSE [n_name] END AS one FROM nation")
def values_as_arrays(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", V.as_array(F.when(F.col("n_nationkey") % 3 > 0, F.col("n_name"))).alias("one"))


@register("numbered_siblings", "SELECT n_nationkey, 'text,text_1,text_' || n_nationkey AS keys FROM nation")
def numbered_siblings(spark, sf_dir):
    order = F.array(F.lit("title"), F.lit("text"), F.lit("text_1"), F.lit("texts"), F.concat(F.lit("text_"), "n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(V.siblings(order, "text"), ",").alias("keys"))


@register("values_in_order", "SELECT n_nationkey, n_name || ',' || n_regionkey AS found FROM nation")
def values_in_order(spark, sf_dir):
    items = F.create_map(F.lit("b"), F.col("n_regionkey").cast("string"), F.lit("a"), "n_name", F.lit("c"), F.lit("left out"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(V.in_order(items, F.array(F.lit("a"), F.lit("gone"), F.lit("b"))), ",").alias("found"))


@register("moved_elements", "SELECT n_nationkey, CASE n_nationkey % 2 WHEN 0 THEN 'b,c,' || n_name || ',d' ELSE 'd,' || n_name || ',b,c' END AS x FROM nation")
def moved_elements(spark, sf_dir):
    items = F.array(F.col("n_name"), F.lit("b"), F.lit("c"), F.lit("d"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.when(F.col("n_nationkey") % 2 == 0, V.moved(items, 0, 2)).otherwise(V.moved(items, 3, 0)), ",").alias("x"))


@register("first_of_candidates", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'link' WHEN 1 THEN 'url' WHEN 2 THEN p_name END AS href FROM part")
def first_of_candidates(spark, sf_dir):
    at = F.col("p_partkey") % 4
    return table(spark, sf_dir, "part").select("p_partkey", V.or_else(F.when(at == 0, "link").otherwise(F.lit("")), F.when(at == 1, "url"), F.when(at == 2, F.col("p_name"))).alias("href"))


@register("choice_lists", "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN 'NF' ELSE n_name || CASE WHEN n_nationkey % 3 = 2 THEN ',z' ELSE '' END END AS choices, n_nationkey % 3 = 2 AS keyed FROM nation")
def choice_lists(spark, sf_dir):
    at, option = F.col("n_nationkey") % 3, lambda k, v: F.struct(F.lit(k).cast("string").alias("key"), v.alias("value"))
    options = F.when(at == 1, F.array(option(None, F.col("n_name")), F.lit(None))).when(at == 2, F.array(option("k", F.col("n_name")), option(None, F.lit("z"))))
    found = V.choices(options)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(found, lambda o: o["value"]), ",").alias("choices"), V.has_keys(found).alias("keyed"))


@register("fragment_kinds", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS sure, CASE page_id % 4 WHEN 0 THEN 'fragment' WHEN 3 THEN 'container' ELSE 'component' END AS kind FROM pages")
def fragment_kinds(spark, sf_dir):
    at = F.col("page_id") % 4
    kind = F.when(at == 0, "x/experiencefragment/v1").when(at == 3, "x/container").otherwise(F.lit("x/text"))
    path = F.when(at == 1, F.concat(F.lit("/content/experience-fragments/"), "page_id")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", classify.fragment_confidence(kind, path, F.when(at == 2, "a fragment").otherwise(F.lit("page"))).alias("sure"), classify.path_kind(kind).alias("kind"))


@register("table_shapes", "SELECT n_regionkey, count(*)::INTEGER AS n_rows, max(n_nationkey % 4)::INTEGER AS n_columns FROM nation GROUP BY 1")
def table_shapes(spark, sf_dir):
    cells = F.slice(F.array(*[F.lit("x")] * 3), F.lit(1), (F.col("n_nationkey") % 4).cast("int"))
    tables = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(cells).alias("rows"))
    return tables.select("n_regionkey", V.table_shape(F.col("rows")).alias("s")).select("n_regionkey", "s.*")


@register("admin_organisations", "SELECT n_regionkey, max(n_nationkey) > 20 AS admin FROM nation GROUP BY 1")
def admin_organisations(spark, sf_dir):
    roles = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey") > 20).alias("admin"))).alias("roles"))
    return roles.select("n_regionkey", V.any_true(F.col("roles"), "admin").alias("admin"))


@register("compatible_ids", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'ab12' WHEN 1 THEN '{-}' ELSE lower(replace(p_brand, '-', '')) END AS id FROM part")
def compatible_ids(spark, sf_dir):
    given = F.when(F.col("p_partkey") % 3 == 0, "{AB-12}").when(F.col("p_partkey") % 3 == 1, "{-}").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", X.compact_id(given).alias("id"))
