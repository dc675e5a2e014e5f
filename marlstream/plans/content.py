"""Content compositions over the tables, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.functions import documents, text
from marlstream.operators import content, windows
from marlstream.plans.catalog import register, table


@register("richtext_nodes")
def richtext_nodes(spark, sf_dir):
    return documents.node_rows(table(spark, sf_dir, "pages"), ["page_id"], "html")


@register("richtext_markdown")
def richtext_markdown(spark, sf_dir):
    return documents.markdown_rows(table(spark, sf_dir, "pages"), ["page_id"], "html")


@register("html_parsed_text")
def html_parsed_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", documents.parsed_text(F.col("html")).alias("body"))


@register("infer_schema", "SELECT event_type, 'OBJECT<k: BIGINT>' AS schema, min(props) AS sample FROM events GROUP BY 1")
def infer_schema(spark, sf_dir):
    return content.inferred_schema(table(spark, sf_dir, "events"), ["event_type"], "props")


@register(
    "term_ancestors",
    """WITH RECURSIVE a AS (SELECT p_partkey AS uid, p_partkey // 3 AS ancestor, 1::BIGINT AS distance FROM part WHERE p_partkey > 0
       UNION ALL SELECT a.uid, a.ancestor // 3, a.distance + 1 FROM a WHERE a.ancestor > 0) SELECT * FROM a""",
)
def term_ancestors(spark, sf_dir):
    nodes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("uid"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 3)).alias("parent"))
    return content.ancestors(nodes, "uid", "parent")


@register(
    "guid_references",
    """WITH g AS (SELECT c_custkey, '{0000000' || (c_custkey % 5) || '-AAAA-BBBB-CCCC-00000000000' || (c_custkey % 7) || '}' AS a, '{0000000' || (c_custkey % 3) || '-AAAA-BBBB-CCCC-000000000001}' AS b FROM customer),
    i AS (SELECT DISTINCT lower(replace(replace(replace(a, '-', ''), '{', ''), '}', '')) AS id FROM g WHERE c_custkey % 2 = 0),
    e AS (SELECT c_custkey, unnest(list_distinct([a, b])) AS x FROM g)
    SELECT c_custkey, count(*) AS n_refs FROM e JOIN i ON i.id = lower(replace(replace(replace(x, '-', ''), '{', ''), '}', '')) GROUP BY 1""",
)
def guid_references(spark, sf_dir):
    name = lambda m, last: F.concat(F.lit("{0000000"), (F.col("c_custkey") % m).cast("string"), F.lit("-AAAA-BBBB-CCCC-00000000000"), last, F.lit("}"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", name(5, (F.col("c_custkey") % 7).cast("string")).alias("a"), name(3, F.lit("1")).alias("b"))
    index = rows.where("c_custkey % 2 = 0").select(F.explode(content.guids(F.col("a"))).alias("id")).distinct()
    each = rows.select("c_custkey", F.explode(F.array_distinct(content.guids(F.concat_ws(" | ", "a", "b")))).alias("id"))
    return each.join(index, "id").groupBy("c_custkey").agg(F.count("*").alias("n_refs"))


@register(
    "authors_by_name",
    "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON 'Customer#' || lpad((o_custkey % 1000)::VARCHAR, 9, '0') = trim(c_name)",
)
def authors_by_name(spark, sf_dir):
    creator = F.concat(F.lit(" Customer#,"), F.lpad((F.col("o_custkey") % 1000).cast("string"), 9, "0"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", creator.alias("creator"))
    return content.by_author(orders, "creator", table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name").select("o_orderkey", "c_custkey")


@register("page_locales", "SELECT page_id, CASE lang WHEN 'en' THEN 'en-us' WHEN 'de' THEN 'de-de' ELSE 'master' END AS locale FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN coalesce(nullif(regexp_extract(html, 'lang=\"([a-z]+)\"', 1), ''), 'de') ELSE 'de' END AS lang FROM pages)")
def page_locales(spark, sf_dir):
    language = F.when(F.col("page_id") % 2 == 0, F.regexp_extract("html", 'lang="([a-z]+)"', 1)).otherwise("")
    return table(spark, sf_dir, "pages").select("page_id", content.page_locale(language, F.lit("/site/de"), {"en": "en-us", "de": "de-de"}, "master").alias("locale"))


@register("locale_table", "SELECT DISTINCT d.lang AS code, coalesce(v.name, d.lang) AS name, CASE WHEN d.lang <> 'en' THEN 'en' END AS fallback_locale FROM documents d LEFT JOIN (VALUES ('en', 'English'), ('de', 'German')) v(code, name) ON v.code = d.lang WHERE d.lang IS NOT NULL")
def locale_table(spark, sf_dir):
    names = spark.createDataFrame([("en", "English"), ("de", "German")], "code string, name string")
    return content.locale_table(table(spark, sf_dir, "documents").where("lang IS NOT NULL"), "lang", names, "en")


@register(
    "required_fields",
    """WITH f AS (SELECT p_brand, p_name AS uid, min(p_type) AS type, min(p_size) AS pos FROM part GROUP BY ALL)
    SELECT * FROM f UNION ALL SELECT b, v.uid, v.type, v.pos FROM (SELECT DISTINCT p_brand AS b FROM f) CROSS JOIN (VALUES ('title', 'text', -2), ('red widget', 'text', -1)) v(uid, type, pos) WHERE NOT EXISTS (SELECT 1 FROM f WHERE p_brand = b AND f.uid = v.uid)""",
)
def required_fields(spark, sf_dir):
    fields = table(spark, sf_dir, "part").groupBy("p_brand", F.col("p_name").alias("uid")).agg(F.min("p_type").alias("type"), F.min("p_size").alias("pos"))
    return content.with_required(fields, ["p_brand"], {"title": "text", "red widget": "text"})


@register("model_merge", "SELECT p_brand, p_name, list_sort(list(p_size))[len(list(p_size)) // 2 + 1] AS p_size, arg_min(p_type, (p_size, p_type)) FILTER (WHERE p_type <> 'SMALL') AS p_type, count(*) AS n_files FROM part GROUP BY ALL")
def model_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_size", F.when(F.col("p_type") != "SMALL", F.col("p_type")).alias("p_type"))
    return content.merged_models(part, "p_brand", "p_name", "p_size", "p_type")


@register("block_merge", "SELECT p_brand, p_name, array_to_string(list(p_type ORDER BY k), ',') AS blocks FROM (SELECT p_brand, p_name, p_type, min(p_partkey) AS k FROM part GROUP BY ALL) GROUP BY ALL")
def block_merge(spark, sf_dir):
    merged = content.merged_blocks(table(spark, sf_dir, "part"), "p_brand", "p_name", "p_partkey", "p_type")
    return merged.select("p_brand", "p_name", F.array_join("blocks", ",").alias("blocks"))


@register("reference_prune", "SELECT o_orderkey, array_to_string(list_sort(list_filter(list_distinct(list(l_returnflag)), lambda x: x IN ('A', 'N'))), ',') AS refs FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def reference_prune(spark, sf_dir):
    """References of a schema that point to chosen content types only."""
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_returnflag").alias("refs"))
    kept = F.array_sort(F.array_intersect("refs", F.array(F.lit("A"), F.lit("N"))))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lists, "o_orderkey").select("o_orderkey", F.array_join(kept, ",").alias("refs"))


@register("display_fields", "SELECT c_custkey, r_name FROM customer JOIN region ON lower(regexp_replace(r_name, '[^a-zA-Z0-9]+', '', 'g')) = lower(regexp_replace(CASE c_nationkey % 3 WHEN 0 THEN 'As-ia' WHEN 1 THEN 'africa' ELSE 'x' END, '[^a-zA-Z0-9]+', '', 'g'))")
def display_fields(spark, sf_dir):
    name = F.when(F.col("c_nationkey") % 3 == 0, "As-ia").when(F.col("c_nationkey") % 3 == 1, "africa").otherwise("x")
    own = table(spark, sf_dir, "customer").select("c_custkey", text.letters_and_digits(name).alias("key"))
    return own.join(table(spark, sf_dir, "region").select("r_name", text.letters_and_digits(F.col("r_name")).alias("key")), "key").select("c_custkey", "r_name")


@register("advanced_settings", "SELECT o_orderkey, o_orderstatus = 'F' AS required, CASE WHEN o_orderkey % 2 = 0 THEN '^[a-z]+$' END AS pattern, NOT (o_orderkey % 3 = 0) AS non_localizable, substr(repeat(o_orderpriority, 30), 1, 255) AS description FROM orders")
def advanced_settings(spark, sf_dir):
    validations = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("^[a-z]+$"), F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderstatus") == "F").alias("required"), F.get(validations, F.lit(0)).alias("pattern"),
        (~(F.col("o_orderkey") % 3 == 0)).alias("non_localizable"), text.truncated(F.repeat("o_orderpriority", 30)).alias("description"),
    )


@register(
    "asset_records",
    """SELECT 'assets_' || page_id AS uid, regexp_extract(url, '[^/]*$', 0) AS filename, strlen(html) AS file_size, first_path, n_paths FROM (
        SELECT min(page_id) AS page_id, arg_min(url, page_id) AS url, arg_min(html, page_id) AS html, arg_min(url, page_id) AS first_path, count(*) AS n_paths FROM pages GROUP BY regexp_extract(url, '[^/]*$', 0))""",
)
def asset_records(spark, sf_dir):
    """One asset for each file name, the first path giving its content, and how many paths lead to it."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").alias("size"), F.substring_index("url", "/", -1).alias("filename"))
    first = pages.groupBy("filename").agg(F.min(F.struct("page_id", "url", "size")).alias("f"), F.count("*").alias("n_paths"))
    return first.select(F.concat(F.lit("assets_"), F.col("f.page_id").cast("string")).alias("uid"), "filename", F.col("f.size").cast("long").alias("file_size"), F.col("f.url").alias("first_path"), "n_paths")


@register("first_of_type", "SELECT user_id, arg_min(event_id, ts) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY 1")
def first_of_type(spark, sf_dir):
    found = windows.samples(table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return found.select("user_id", "event_id")


@register("audit_flags", "SELECT l.doc_id, d.source, coalesce(l.toxic, 0) AS toxic, CASE WHEN l.quality = 0 THEN 'low' WHEN l.toxic = 1 THEN 'toxic' ELSE 'fine' END AS flag FROM labels l LEFT JOIN documents d USING (doc_id)")
def audit_flags(spark, sf_dir):
    from marlstream.operators.classify import first_rule

    flag = first_rule([(F.col("quality") == 0, "low"), (F.col("toxic") == 1, "toxic")], "fine")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", "left").select("doc_id", "source", F.coalesce("toxic", F.lit(0)).alias("toxic"), flag.alias("flag"))
