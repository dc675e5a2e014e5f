"""Joins, grouping, windows, set operations, trees and metadata changes over the tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.functions import values as V
from marlstream.operators import classify, lookup, merge, metadata, paging, trees, windows
from marlstream.plans.catalog import register, table


# --- filters and searches ---------------------------------------------------------------------------------------


@register("search_any_column", "SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(lower(o_orderstatus), 'p') OR contains(lower(o_orderpriority), 'p')")
def search_any_column(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return orders.where(paging.matches_any(paging.string_columns(orders), "P")).select("o_orderkey", "o_orderpriority")


@register("filter_multi_or", "SELECT event_id, event_type FROM events WHERE contains(lower(event_type), 'error') OR contains(lower(event_type), 'view')")
def filter_multi_or(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type").where(paging.matches_choice("event_type", "error-view"))


@register("log_levels_distinct", "SELECT DISTINCT event_type AS level FROM events")
def log_levels_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("level")).distinct()


@register("log_trim_window", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn > 0 AND rn < n - 2")
def log_trim_window(spark, sf_dir):
    return windows.trimmed(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"])


@register("log_page", "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn, count(*) OVER () AS n FROM events) WHERE rn > 0 AND rn < n - 2 AND contains(lower(event_type), 'error') AND contains(lower(props), '1') ORDER BY event_id LIMIT 20 OFFSET 10")
def log_page(spark, sf_dir):
    rows = windows.trimmed(table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ["event_id"])
    found = rows.where(paging.matches_choice("event_type", "error") & paging.matches_any(["props"], "1"))
    return paging.page(found, ["event_id"], 10, 20).select("event_id", "event_type")


@register("status_filter", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' AND o_orderpriority IS DISTINCT FROM '1-URGENT' AND o_orderstatus IN ('O', 'F')")
def status_filter(spark, sf_dir):
    kind = F.col("o_orderpriority")
    return table(spark, sf_dir, "orders").where(~kind.eqNullSafe("5-LOW") & ~kind.eqNullSafe("1-URGENT") & F.col("o_orderstatus").isin("O", "F")).select("o_orderkey", "o_orderstatus")


@register("required_sections", "SELECT regexp_extract(html, 'lang=\"([a-z]+)\"', 1) AS lang, bool_and(contains(html, '<title>') AND contains(html, '<body>')) AS complete FROM pages GROUP BY 1")
def required_sections(spark, sf_dir):
    has = F.contains("html", F.lit("<title>")) & F.contains("html", F.lit("<body>"))
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang")).agg(F.bool_and(has).alias("complete"))


@register("folder_rule", "SELECT source, bool_or(lang = 'en') AND bool_or(lang = 'de') AS valid FROM documents GROUP BY source")
def folder_rule(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg((F.bool_or(F.col("lang") == "en") & F.bool_or(F.col("lang") == "de")).alias("valid"))


@register("missing_sections", "SELECT r_name AS section FROM region WHERE r_name NOT IN (SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE n_nationkey < 3)")
def missing_sections(spark, sf_dir):
    """Required sections that a package lacks."""
    required = table(spark, sf_dir, "region").select(F.col("r_name").alias("section"), "r_regionkey")
    present = table(spark, sf_dir, "nation").where("n_nationkey < 3").select(F.col("n_regionkey").alias("r_regionkey"))
    return merge.minus(required, present, ["r_regionkey"]).select("section")


# --- joins ------------------------------------------------------------------------------------------------------


@register(
    "ordered_children",
    """SELECT x.o_custkey, (i - 1)::INTEGER AS pos, ks[i] AS o_orderkey, o_totalprice
    FROM (SELECT o_custkey, ks, unnest(range(1, len(ks) + 1)) AS i FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks FROM orders GROUP BY 1)) x
    LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON o.o_orderkey = ks[i]""",
)
def ordered_children(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    parents = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return lookup.ordered_children(parents, "keys", orders.where("o_orderstatus != 'P'").select("o_orderkey", "o_totalprice"), "o_orderkey").select("o_custkey", "pos", "o_orderkey", "o_totalprice")


@register("join_editor_controls", "SELECT n_nationkey, coalesce(r_name, n_name) AS name, r_regionkey IS NOT NULL AS has_control FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def join_editor_controls(spark, sf_dir):
    fields = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("key"))
    controls = table(spark, sf_dir, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"), F.lit(True).alias("control"))
    found = lookup.right_biased(fields, controls, ["key"])
    return found.select("n_nationkey", "name", F.coalesce("control", F.lit(False)).alias("has_control"))


@register("join_multi_key", "SELECT l_orderkey, l_linenumber, s_name, p_brand FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') AND s_nationkey = p_size % 25")
def join_multi_key(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R")).select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", (F.col("p_size") % 25).alias("s_nationkey"))
    return lines.join(supplier, "l_suppkey").join(part, ["l_partkey", "s_nationkey"]).select("l_orderkey", "l_linenumber", "s_name", "p_brand")


@register(
    "join_candidate_priority",
    """WITH i AS (SELECT url AS k, page_id AS found FROM pages WHERE page_id % 2 = 0),
    c AS (SELECT page_id, url AS k, 0 AS p FROM pages UNION ALL SELECT page_id, lower(url), 1 FROM pages
          UNION ALL SELECT a.page_id, b.url, 2 FROM pages a JOIN pages b ON b.page_id = a.page_id - 1)
    SELECT pages.page_id, m.found, m.priority FROM pages LEFT JOIN (SELECT page_id, arg_min(found, (p, found)) AS found, min(p)::INTEGER AS priority FROM c JOIN i USING (k) GROUP BY 1) m USING (page_id)""",
)
def join_candidate_priority(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    index = merge.first_wins(pages.where("page_id % 2 = 0").select(F.col("url").alias("k"), F.col("page_id").alias("found")), ["k"], "found")
    rows = pages.join(pages.select((F.col("page_id") + 1).alias("page_id"), F.col("url").alias("other")), "page_id", "left")
    return lookup.by_candidates(rows, "page_id", [F.col("url"), F.lower("url"), F.col("other")], index, "k", "found").select("page_id", "found", "priority")


@register("join_last_segment", "SELECT a.page_id, count(*) AS n FROM pages a JOIN pages b ON regexp_extract(a.url, '[^/]*$', 0) = regexp_extract(b.url, '[^/]*$', 0) GROUP BY 1")
def join_last_segment(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.substring_index("url", "/", -1).alias("leaf"))
    # the other side is counted before the join, so that a frequent leaf makes no pairs
    return pages.join(pages.groupBy("leaf").agg(F.count("*").alias("n")), "leaf").select("page_id", "n")


@register("semi_refs", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def semi_refs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(orders, "c_custkey", "left_semi")


@register("anti_stacks", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F' AND year(o_orderdate) = 1997)")
def anti_stacks(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "F") & (F.year("o_orderdate") == 1997)).select(F.col("o_custkey").alias("c_custkey"))
    return merge.minus(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@register("upsert_union", "SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 3 <> 0 UNION ALL SELECT s_suppkey, 'new ' || s_name, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, 'new ' || s_name, 0.0::DOUBLE FROM supplier WHERE s_suppkey % 5 = 0")
def upsert_union(spark, sf_dir):
    old = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    made = lambda rows, key: rows.select(key.alias("s_suppkey"), F.concat(F.lit("new "), "s_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    new = made(old.where("s_suppkey % 3 = 0"), F.col("s_suppkey")).unionByName(made(old.where("s_suppkey % 5 = 0"), F.col("s_suppkey") + 1000000))
    return merge.upsert(old, new, ["s_suppkey"])


@register("schema_merge", "WITH s AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part WHERE p_size < 10 GROUP BY ALL), t AS (SELECT p_brand, p_type, min(p_partkey) AS k FROM part WHERE p_size >= 5 GROUP BY ALL) SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.p_brand = t.p_brand AND s.p_type = t.p_type)")
def schema_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_partkey").alias("k"), "p_size")
    one = lambda rows: merge.first_wins(rows.select("p_brand", "p_type", "k"), ["p_brand", "p_type"], "k")
    return merge.merged_schema(one(part.where("p_size < 10")), one(part.where("p_size >= 5")), ["p_brand", "p_type"])


_TYPES = "SELECT DISTINCT regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS t FROM pages"


@register(
    "self_join_parent",
    f"""WITH a AS ({_TYPES}), b AS (SELECT t FROM a UNION SELECT regexp_replace(t, '/[^/]+$', '') FROM a)
    SELECT x.t AS type, y.t AS parent FROM b x LEFT JOIN b y ON y.t = regexp_replace(x.t, '/[^/]+$', '')""",
)
def self_join_parent(spark, sf_dir):
    own = table(spark, sf_dir, "pages").select(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "").alias("type")).distinct()
    nodes = own.union(own.select(F.regexp_replace("type", "/[^/]+$", ""))).distinct()
    return lookup.by_parent_type(nodes.withColumn("own", F.col("type")), "type").select("type", F.col("parent_own").alias("parent"))


@register("cross_locales", "SELECT n_nationkey, n_name, l AS locale FROM nation CROSS JOIN (VALUES ('en'), ('de'), ('fr')) v(l)")
def cross_locales(spark, sf_dir):
    return lookup.replicated(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["en", "de", "fr"])


RULES = (("ECONOMY", "AFRICA"), ("ECONOMY", "ASIA"), ("SMALL", "EUROPE"), ("STANDARD", "AMERICA"))
_RULES_SQL = ", ".join(f"('{a}', '{b}')" for a, b in RULES)


@register("theta_compat", f"SELECT p_partkey, r_name FROM part JOIN (VALUES {_RULES_SQL}) v(s, t) ON p_type = s JOIN region ON r_name = t")
def theta_compat(spark, sf_dir):
    rules = spark.createDataFrame(RULES, "source_type string, target_type string")
    return lookup.compatible(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", rules, table(spark, sf_dir, "region"), "r_name").select("p_partkey", "r_name")


@register("reference_rebuild", "SELECT o_orderkey, coalesce(string_agg(s_name, ',' ORDER BY l_linenumber, l_partkey, l_suppkey), '') AS refs FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) s ON s_suppkey = l_suppkey GROUP BY 1")
def reference_rebuild(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    lists = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l_suppkey"]).alias("keys"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey").join(lists, "o_orderkey", "left")
    index = table(spark, sf_dir, "supplier").where("s_suppkey % 4 != 0").select("s_suppkey", "s_name")
    return lookup.resolve_references(orders, "o_orderkey", "keys", index, "s_suppkey", "s_name").select("o_orderkey", F.array_join("found", ",").alias("refs"))


@register("repair_references", "SELECT e.event_id, CASE WHEN EXISTS (SELECT 1 FROM events x WHERE x.event_type = e.event_type AND x.event_id = e.user_id) THEN e.user_id ELSE f.m END AS ref FROM events e JOIN (SELECT event_type, min(event_id) AS m FROM events GROUP BY 1) f USING (event_type)")
def repair_references(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    index = events.select(F.col("event_type").alias("t"), F.col("event_id").alias("u"))
    return lookup.repaired(events.withColumnRenamed("user_id", "ref"), "event_id", "event_type", "ref", index, "t", "u").select("event_id", "ref")


# --- grouping and merging ---------------------------------------------------------------------------------------


@register("group_entries", "SELECT source, lang, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source, lang")
def group_entries(spark, sf_dir):
    return merge.last_wins(table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars"), ["source", "lang"], "doc_id")


@register("first_last_wins", "SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id")
def first_last_wins(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return turns.groupBy("conv_id").agg(F.min_by("role", "turn").alias("first_role"), F.max_by("text", "turn").alias("last_text"))


@register("merge_non_null", "SELECT user_id, arg_min(event_type, event_id) FILTER (WHERE event_type <> 'view') AS kind, arg_min(value, event_id) FILTER (WHERE value > 50) AS value FROM events GROUP BY user_id")
def merge_non_null(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), F.when(F.col("value") > 50, F.col("value")).alias("value"))
    return merge.first_non_null(events, ["user_id"], "event_id")


@register("group_first_non_null", "SELECT coalesce(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END, ''), o_orderpriority) AS key, count(*) AS n FROM orders GROUP BY 1")
def group_first_non_null(spark, sf_dir):
    first = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").groupBy(V.or_else(first, F.col("o_orderpriority")).alias("key")).agg(F.count("*").alias("n"))


@register("choice_fold", "SELECT n_regionkey, string_agg(n_name, '/' ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1")
def choice_fold(spark, sf_dir):
    return merge.folded_choices(table(spark, sf_dir, "nation"), "n_regionkey", "n_name", "n_nationkey")


@register("upper_median", "SELECT event_type, list_sort(list(value))[len(list(value)) // 2 + 1] AS median FROM events GROUP BY 1")
def upper_median(spark, sf_dir):
    return windows.upper_medians(table(spark, sf_dir, "events"), "event_type", "value")


@register("count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("entry_counts", "SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def entry_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))


@register("union_distinct", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@register("union_all", "SELECT c_nationkey AS nation, 'customer' AS kind, c_acctbal AS a, NULL::DOUBLE AS b FROM customer UNION ALL SELECT s_nationkey, 'supplier', NULL, s_acctbal FROM supplier")
def union_all(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("a"))
    return one.unionByName(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("b")), allowMissingColumns=True)


@register("keyed_union_last", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'new' ELSE n_name END AS n_name FROM nation")
def keyed_union_last(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.lit(0).alias("pos"))
    later = nation.where("n_nationkey % 2 = 0").select("n_nationkey", F.lit("new").alias("n_name"), F.lit(1).alias("pos"))
    return merge.last_wins(nation.unionByName(later), ["n_nationkey"], "pos").drop("pos")


@register("richer_schema", "SELECT event_type, arg_max(event_id, (length(props), -event_id)) AS event_id, arg_max(props, (length(props), -event_id)) AS props FROM events GROUP BY 1")
def richer_schema(spark, sf_dir):
    return merge.richer(table(spark, sf_dir, "events").select("event_type", "event_id", "props"), "event_type", F.length("props"), "event_id")


@register("locale_set", "SELECT lang AS locale FROM documents WHERE lang IS NOT NULL UNION SELECT regexp_extract(html, 'lang=\"([a-z]+)\"', 1) FROM pages")
def locale_set(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("html", 'lang="([a-z]+)"', 1))
    return table(spark, sf_dir, "documents").select(F.col("lang").alias("locale")).where("locale IS NOT NULL").union(pages).distinct()


@register("mapping_validity", "SELECT p_brand, CASE WHEN bool_and(coalesce(p_type <> 'SMALL', false)) THEN 2 ELSE 3 END AS status FROM part GROUP BY 1")
def mapping_validity(spark, sf_dir):
    kind = F.when(F.col("p_type") == "SMALL", "No matches found").otherwise(F.col("p_type")).alias("kind")
    return merge.valid_mapping(table(spark, sf_dir, "part").select("p_brand", kind, F.col("p_name").alias("uid")), ["p_brand"], "kind", "uid")


# --- windows, chunks, samples -----------------------------------------------------------------------------------


@register("row_ids", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS id FROM events")
def row_ids(spark, sf_dir):
    return windows.numbered(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"], "id").select("event_id", "id")


@register("sample_per_group", "SELECT source, lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) <= 2")
def sample_per_group(spark, sf_dir):
    return windows.samples(table(spark, sf_dir, "documents").select("source", "lang", "doc_id"), ["source", "lang"], ["doc_id"], 2)


@register("dup_title_suffix", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY t ORDER BY doc_id) > 1 THEN t || ' - ' || doc_id ELSE t END AS title FROM (SELECT doc_id, text AS t FROM documents)")
def dup_title_suffix(spark, sf_dir):
    return merge.unique_titles(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("title")), "title", "doc_id")


@register("chunk_by_bytes", "SELECT doc_id, floor(coalesce(sum(b) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1048576)::BIGINT AS chunk FROM (SELECT doc_id, strlen(coalesce(text, '')) AS b FROM documents)")
def chunk_by_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))
    return windows.chunks_by_bytes(docs, ["doc_id"], F.col("b")).select("doc_id", "chunk")


@register("chunk_by_count", "SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 100)::BIGINT AS chunk FROM orders")
def chunk_by_count(spark, sf_dir):
    return windows.chunks_by_count(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@register("group_header_carry", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS header FROM events")
def group_header_carry(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return windows.carried(events, ["user_id"], ["event_id"], F.when(F.col("event_type") == "signup", F.col("event_id")), "header").select("event_id", "header")


@register("first_appearance_order", "SELECT event_type, row_number() OVER (ORDER BY m, event_type) AS rank FROM (SELECT event_type, min(event_id) AS m FROM events GROUP BY 1)")
def first_appearance_order(spark, sf_dir):
    return windows.appearance_order(table(spark, sf_dir, "events").select("event_type", "event_id"), "event_type", "event_id")


@register("window_events_daily", "SELECT ts::DATE AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def window_events_daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


# --- trees ------------------------------------------------------------------------------------------------------

_DOTTED = "replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', ''), '/', '>')"


def _paths(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", F.translate(bare, "/", ">").alias("path"))


_EACH = f"SELECT DISTINCT array_to_string(p[:i], '>') AS path, i AS depth FROM (SELECT p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT list_filter(string_split({_DOTTED}, '>'), lambda x: x <> '') AS p FROM pages))"


@register("url_path_closure", f"SELECT path, depth::INTEGER AS depth FROM ({_EACH})")
def url_path_closure(spark, sf_dir):
    return trees.closure(_paths(spark, sf_dir), "path", ">")


@register("path_depth_deepest", f"SELECT page_id, len(p)::INTEGER AS depth, p[-1] AS leaf, CASE WHEN len(p) > 1 THEN array_to_string(p[:len(p) - 1], '>') END AS parent FROM (SELECT page_id, list_filter(string_split({_DOTTED}, '>'), lambda x: x <> '') AS p FROM pages) ORDER BY len(p) DESC, page_id LIMIT 20")
def path_depth_deepest(spark, sf_dir):
    path = F.col("path")
    found = _paths(spark, sf_dir).select("page_id", trees.depth(path, ">").alias("depth"), trees.leaf(path, ">").alias("leaf"), trees.parent(path, ">").alias("parent"))
    return paging.page(found, [F.desc("depth"), "page_id"], 0, 20)


@register("path_depths", f"SELECT page_id, len(p)::INTEGER AS depth, p[-1] AS leaf, CASE WHEN len(p) > 1 THEN array_to_string(p[:len(p) - 1], '>') END AS parent FROM (SELECT page_id, list_filter(string_split({_DOTTED}, '>'), lambda x: x <> '') AS p FROM pages)")
def path_depths(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("page_id", trees.depth(path, ">").alias("depth"), trees.leaf(path, ">").alias("leaf"), trees.parent(path, ">").alias("parent"))


@register("child_counts", f"SELECT array_to_string(p[:len(p) - 1], '>') AS path, count(*) AS n_children FROM (SELECT DISTINCT string_split(path, '>') AS p FROM ({_EACH})) WHERE len(p) > 1 GROUP BY 1")
def child_counts(spark, sf_dir):
    return trees.child_counts(trees.closure(_paths(spark, sf_dir), "path", ">"), "path", ">")


@register("tree_orphans", f"WITH n AS (SELECT path FROM ({_EACH}) WHERE depth <> 2) SELECT path, CASE WHEN contains(path, '>') THEN regexp_replace(path, '>[^>]*$', '') END AS parent, contains(path, '>') AND regexp_replace(path, '>[^>]*$', '') NOT IN (SELECT path FROM n) AS is_orphan FROM n")
def tree_orphans(spark, sf_dir):
    nodes = trees.closure(_paths(spark, sf_dir), "path", ">").where("depth != 2").select("path")
    return trees.with_parents(nodes, "path", ">").select("path", "parent", "is_orphan")


@register("tree_descendants", f"WITH n AS ({_EACH}) SELECT r.path AS root, n.path FROM n JOIN n r ON r.depth = 2 AND starts_with(n.path, r.path || '>')")
def tree_descendants(spark, sf_dir):
    nodes = trees.closure(_paths(spark, sf_dir), "path", ">")
    roots = nodes.where("depth = 2").select(F.col("path").alias("root"))
    return trees.descendants(nodes.select("path"), "path", roots, "root", ">").select("root", "path")


@register("select_closure", f"WITH e AS (SELECT array_to_string(p[:i], '>') AS path, page_id FROM (SELECT page_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT page_id, list_filter(string_split({_DOTTED}, '>'), lambda x: x <> '') AS p FROM pages))) SELECT path, bool_or(page_id % 5 = 0) AS checked FROM e GROUP BY 1")
def select_closure(spark, sf_dir):
    return trees.checked_upwards(_paths(spark, sf_dir).withColumn("checked", F.col("page_id") % 5 == 0), "path", "checked", ">")


@register("schema_nesting", "SELECT n_regionkey, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS fields FROM nation GROUP BY 1")
def schema_nesting(spark, sf_dir):
    nested = trees.nested(table(spark, sf_dir, "nation"), [], "n_regionkey", "n_nationkey", ["n_name"], "fields")
    return nested.select("n_regionkey", F.to_json("fields").alias("fields"))


@register("json_flatten", "SELECT event_id, k AS path, (props ->> ('$.' || k)) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def json_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return events.select("event_id", F.explode("m").alias("path", "value"))


# --- metadata ---------------------------------------------------------------------------------------------------


@register("step_machine", "SELECT o_orderkey, CASE WHEN s = 0 AND t = 1 THEN 1 WHEN s = 1 AND t = 2 THEN 2 WHEN s = 2 AND t = 3 THEN 3 WHEN s = 3 AND t = 4 THEN 4 WHEN s = 4 AND t = 5 THEN 5 ELSE s END AS status FROM (SELECT o_orderkey, (o_orderkey % 5)::INTEGER AS s, (substr(o_orderpriority, 1, 1))::INTEGER AS t FROM orders)")
def step_machine(spark, sf_dir):
    status, step = (F.col("o_orderkey") % 5).cast("int"), F.substring("o_orderpriority", 1, 1).cast("int")
    return table(spark, sf_dir, "orders").select("o_orderkey", classify.next_status(status, step).alias("status"))


@register("reset_mapping", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN coalesce(nullif(p_type, ''), p_name) ELSE p_name END AS field_type, CASE WHEN p_brand = 'Brand#1' THEN false ELSE p_size > 25 END AS is_updated FROM part")
def reset_mapping(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_name").alias("field_type"), F.col("p_type").alias("backup_type"), (F.col("p_size") > 25).alias("is_updated"))
    return metadata.reset(part, F.col("p_brand") == "Brand#1", {"field_type": "backup_type"}).select("p_partkey", "field_type", "is_updated")


@register("soft_delete", "SELECT c_custkey, c_mktsegment, c_custkey % 10 = 0 AS is_deleted FROM customer")
def soft_delete(spark, sf_dir):
    return metadata.soft_delete(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit(False).alias("is_deleted")), F.col("c_custkey") % 10 == 0)


@register("cascade_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey % 10 <> 0")
def cascade_delete(spark, sf_dir):
    gone = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("o_custkey"))
    gone = gone.union(table(spark, sf_dir, "orders").where("o_custkey % 10 = 0").select("o_custkey")).distinct()
    return metadata.cascade_delete(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, "o_custkey")


@register("update_mapping", "SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN upper(p_name) ELSE p_name END AS field_type, p_name AS initial FROM part")
def update_mapping(spark, sf_dir):
    part = metadata.with_initial(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("field_type")), "field_type")
    changes = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select("p_partkey", F.upper("p_name").alias("field_type"))
    return metadata.update(part, changes, ["p_partkey"])


@register("content_types_page", "SELECT b AS title, n, count(*) OVER () AS total FROM (SELECT p_brand AS b, count(*) AS n FROM part WHERE contains(lower(p_brand), '1') GROUP BY 1) ORDER BY b LIMIT 5 OFFSET 2")
def content_types_page(spark, sf_dir):
    found = table(spark, sf_dir, "part").where(paging.matches("p_brand", "1")).groupBy(F.col("p_brand").alias("title")).agg(F.count("*").alias("n"))
    total = found.agg(F.count("*").alias("total"))
    return paging.page(found, ["title"], 2, 5).join(F.broadcast(total))


@register(
    "webhook_topics",
    """WITH t AS (SELECT event_id, unnest(CASE event_type WHEN 'view' THEN ['Entry.publish', 'Asset.create'] WHEN 'click' THEN ['Entry.*'] WHEN 'error' THEN ['ContentType.save', 'ContentType.save'] ELSE ['*.delete'] END) AS topic FROM events),
    m AS (SELECT event_id, unnest(CASE WHEN starts_with(topic, '*') THEN ['content_types', 'content_types.entries', 'assets'] WHEN starts_with(topic, 'Entry') THEN ['content_types.entries'] WHEN starts_with(topic, 'Asset') THEN ['assets'] ELSE ['content_types'] END) AS module, split_part(topic, '.', 2) AS act FROM t),
    a AS (SELECT event_id, module, unnest(CASE WHEN act = '*' THEN ['create', 'update', 'delete', 'publish', 'unpublish'] WHEN act = 'save' THEN ['update'] ELSE [act] END) AS act FROM m)
    SELECT DISTINCT event_id, CASE WHEN act IN ('publish', 'unpublish') THEN module || '.environments.' || act || '.success' ELSE module || '.' || act END AS channel FROM a""",
)
def webhook_topics(spark, sf_dir):
    kind = F.col("event_type")
    said = F.when(kind == "view", F.array(F.lit("Entry.publish"), F.lit("Asset.create"))).when(kind == "click", F.array(F.lit("Entry.*"))).when(kind == "error", F.array(F.lit("ContentType.save"), F.lit("ContentType.save"))).otherwise(F.array(F.lit("*.delete")))
    return table(spark, sf_dir, "events").select("event_id", F.explode(metadata.channels(said)).alias("channel"))
