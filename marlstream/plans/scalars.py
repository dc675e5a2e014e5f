"""Scalar functions over the tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.functions import text as X
from marlstream.functions import values as V
from marlstream.plans.catalog import register, table

#: odd keys that go with the part names, so that every branch of the identifier rules is met
ODD = ("Hero Banner", "heroBanner", "2nd-Level", "$price$", "a--b__c", "locale", "pageURL", "_ids_x", "{AB-12}", "")
_ODD_SQL = "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(ODD)) + " WHEN 10 THEN p_brand || ' ' || p_type ELSE p_name END"


def _keys(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    key = F.when(F.lit(False), "")
    for i, x in enumerate(ODD):
        key = key.when(F.col("p_partkey") % 12 == i, x)
    key = key.when(F.col("p_partkey") % 12 == 10, F.concat("p_brand", F.lit(" "), "p_type")).otherwise(F.col("p_name"))
    return part.select("p_partkey", key.alias("k"))


def _sql(columns: str) -> str:
    return f"WITH x AS (SELECT p_partkey, {_ODD_SQL} AS k FROM part) SELECT p_partkey, {columns} FROM x"


def rx(column: str, *rules: tuple[str, str]) -> str:
    """Nested global regexp_replace of the SQL twins."""
    for pattern, to in rules:
        column = f"regexp_replace({column}, '{pattern}', '{to}', 'g')"
    return column


_UNDER = (("[ -]", "_"), ("[^a-zA-Z0-9_]+", "_"))
_TIDY = (("_+", "_"), ("^_|_$", ""))


@register("uid_snake", _sql(f"{rx('lower(' + rx('k', *_UNDER, ('([A-Z])', chr(95) + chr(92) + '1')) + ')', *_TIDY)} AS uid, lower({rx('k', ('([A-Z])', chr(95) + chr(92) + '1'))}) AS camel"))
def uid_snake(spark, sf_dir):
    return _keys(spark, sf_dir).select("p_partkey", X.snake_uid(F.col("k")).alias("uid"), X.camel_to_snake(F.col("k")).alias("camel"))


_FIELD = rx("k", ("[^a-zA-Z0-9_]", "_"), ("^_+", ""))
_SCHEMA = "lower(" + rx("k", ("^[^a-zA-Z]+", ""), ("[^a-zA-Z0-9]", "_"), ("URL", "url"), ("API", "api"), ("ID", "id"), ("UI", "ui"), ("([A-Z]+)([A-Z][a-z])", r"\1_\2"), (r"([a-z\d])([A-Z])", r"\1_\2"), *_TIDY) + ")"
_COMPONENT = rx("k", ("^:", ""), ("([a-z0-9])([A-Z])", r"\1_\2"), ("[ :-]", "_"), ("[^a-zA-Z0-9_]", ""))


@register(
    "uid_variants",
    _sql(f"""
    {rx('lower(' + rx('k', *_UNDER) + ')', *_TIDY)} AS flat,
    lower({rx("CASE WHEN regexp_matches(k, '^[0-9]') THEN 'a_' || k ELSE k END", ("[ -]", "_"))}) AS digit_safe,
    lower(regexp_replace({rx("CASE WHEN regexp_matches(k, '^[0-9]') THEN '_' || k ELSE k END", ("[ -]", "_"))}, '[$]', '')) AS feed,
    lower(CASE WHEN k IN ('locale', 'publish_details', 'tags') OR starts_with(k, '_ids') OR ends_with(k, '_ids') THEN {rx("'cs_' || k", ("[^a-zA-Z0-9]+", "_"))} ELSE k END) AS affixed,
    lower(CASE WHEN regexp_matches({_COMPONENT}, '^[a-zA-Z]') THEN {_COMPONENT} ELSE 'a' || {_COMPONENT} END) AS component,
    lower({rx('k', ('[^a-zA-Z0-9_]', '_'))}) AS word,
    lower(CASE WHEN NOT regexp_matches({_FIELD}, '^[a-zA-Z]') THEN 'field_' || {_FIELD} WHEN {_FIELD} IN ('locale', 'publish_details', 'tags') THEN 'cm_' || {_FIELD} ELSE {_FIELD} END) AS field,
    CASE {_SCHEMA} WHEN '' THEN 'field' WHEN 'locale' THEN 'cm_locale' ELSE {_SCHEMA} END AS schema_key,
    coalesce(nullif(lower({rx('k', ('[-{}]', ''))}), ''), k) AS compact,
    lower({rx('k', ('[^a-zA-Z0-9]+', ''))}) AS display"""),
)
def uid_variants(spark, sf_dir):
    k = F.col("k")
    return _keys(spark, sf_dir).select(
        "p_partkey", X.flat_uid(k).alias("flat"), X.digit_safe_uid(k).alias("digit_safe"), X.feed_uid(k).alias("feed"), X.affixed_uid(k, "cs").alias("affixed"),
        X.component_uid(k).alias("component"), X.word_uid(k).alias("word"), X.field_uid(k).alias("field"), X.schema_uid(k).alias("schema_key"), X.compact_id(k).alias("compact"), X.letters_and_digits(k).alias("display"),
    )


@register(
    "human_title",
    f"""SELECT p_partkey, upper(substr(t, 1, 1)) || substr(t, 2) AS title, '/' || lower(regexp_replace(p_name, ' +', '_', 'g')) AS url
    FROM (SELECT *, trim({rx("p_name || '__' || p_brand || '-x'", ('[-_]+', ' '), (chr(92) + 's+', ' '))}) AS t FROM part)""",
)
def human_title(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", X.human_title(F.concat("p_name", F.lit("__"), "p_brand", F.lit("-x"))).alias("title"), X.author_url(F.col("p_name")).alias("url"))


@register("slug_title", f"SELECT doc_id, lower({rx('text', ('[^a-zA-Z0-9]+', '-'))}) AS slug, coalesce(CASE WHEN trim(lang) <> '' THEN lang END, nullif(source, '')) AS title FROM documents")
def slug_title(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return docs.select("doc_id", X.title_slug(F.col("text")).alias("slug"), X.title_or(F.col("lang"), F.col("source")).alias("title"))


@register("slug_word", f"SELECT doc_id, {rx('lower(text)', ('[|]', ''), ('[^a-zA-Z0-9_' + chr(92) + 's-]', ''), (chr(92) + 's+', '-'), ('-+', '-'), ('^-+|-+$', ''))} AS slug FROM documents")
def slug_word(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug(F.col("text")).alias("slug"))


@register("truncate_255", "SELECT doc_id, substr(text, 1, 255) AS description FROM documents")
def truncate_255(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncated(F.col("text")).alias("description"))


@register(
    "log_level_classify",
    """SELECT event_id, CASE WHEN contains(m, 'error') OR contains(m, 'failed') OR contains(m, 'exception') OR contains(m, 'not found') THEN 'error'
              WHEN contains(m, 'warn') THEN 'warn' ELSE 'info' END AS level
    FROM (SELECT event_id, lower(CASE event_type WHEN 'click' THEN 'Asset not found' WHEN 'view' THEN 'WARNING: slow' ELSE 'x ' || event_type END) AS m FROM events)""",
)
def log_level_classify(spark, sf_dir):
    message = F.when(F.col("event_type") == "click", "Asset not found").when(F.col("event_type") == "view", "WARNING: slow").otherwise(F.concat(F.lit("x "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", X.log_level(message).alias("level"))


@register(
    "log_text_clean",
    r"""SELECT event_id, regexp_replace(chr(27) || '[31m' || event_type || chr(27) || '[0m', '\x1b\[\d+m', '', 'g') AS plain,
        trim(replace(CASE WHEN event_id % 2 = 0 THEN event_type || '-App' ELSE 'x' END, '-App', '')) AS app FROM events""",
)
def log_text_clean(spark, sf_dir):
    coloured = F.concat(F.lit("\x1b[31m"), "event_type", F.lit("\x1b[0m"))
    label = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("x ("), "event_type", F.lit("-App)"))).otherwise(F.lit("x"))
    return table(spark, sf_dir, "events").select("event_id", X.without_colours(coloured).alias("plain"), X.app_name(label).alias("app"))


@register("html_to_text", f"SELECT page_id, trim({rx('html', ('(?is)<(script|style)[^>]*>.*?</(script|style)>', ' '), ('(?s)<[^>]*>', ' '), (chr(92) + 's+', ' '))}) AS body FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.html_text(F.col("html")).alias("body"))


@register("html_title", "SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"))


@register("html_links_count", "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1))::BIGINT AS n_links FROM pages")
def html_links_count(spark, sf_dir):
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_links"))


@register(
    "html_images",
    """SELECT page_id, src, regexp_matches(src, '(?i)[.](jpeg|jpg|png|gif|webp|svg)$') AS image, regexp_extract(src, '[^/]*$', 0) AS name
    FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<(?:img|script|source)[^>]*src="([^"]*)"', 1))) AS src FROM pages)""",
)
def html_images(spark, sf_dir):
    sources = F.array_distinct(F.regexp_extract_all("html", F.lit('<(?:img|script|source)[^>]*src="([^"]*)"'), 1))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(sources).alias("src"))
    return found.select("page_id", "src", X.is_image(F.col("src")).alias("image"), X.file_name(F.col("src")).alias("name"))


_PATH = rx("trim(url)", (r"\?.*$", ""), ("^https?://[^/]+", ""), ("/jcr:content.*$", ""), ("/_jcr_content.*$", ""), (r"\.transform/.*$", ""))


@register(
    "url_parts",
    f"""SELECT page_id, {_PATH} AS path, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
        CASE WHEN regexp_matches(url, '^(https?://|www[.])') THEN url ELSE 'http://x/' || url END AS absolute,
        coalesce(nullif(replace(url, 'https://', ''), ''), '/') AS after_base FROM pages""",
)
def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", X.asset_path(url).alias("path"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"),
        X.absolute_url(url, F.lit("http://x/")).alias("absolute"), X.after_base(url, F.lit("https://")).alias("after_base"),
    )


@register(
    "media_uids",
    """SELECT page_id, CASE page_id % 3 WHEN 0 THEN page_id::VARCHAR || '/a' WHEN 1 THEN page_id::VARCHAR ELSE 'x' || page_id END AS uid,
              'p ' || page_id || '.v2' AS bare, 'png' AS ending FROM pages""",
)
def media_uids(spark, sf_dir):
    page = F.col("page_id").cast("string")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("/-/media/"), page, F.lit("/a.ashx?w=1"))).when(F.col("page_id") % 3 == 1, F.concat(F.lit("/media/"), page, F.lit(".jpg?h=2"))).otherwise(F.concat(F.lit("x"), page))
    name = F.concat(F.lit("p "), page, F.lit(".v2.png"))
    return table(spark, sf_dir, "pages").select("page_id", X.media_uid(url).alias("uid"), X.without_extension(name).alias("bare"), X.extension(name).alias("ending"))


@register(
    "display_helpers",
    """SELECT page_id, CASE WHEN length(url) > 25 THEN substr(url, 1, 15) || '...' || substr(url, -8) ELSE url END AS short,
        CASE WHEN n < 1024 THEN n || 'bytes' WHEN n < 1048576 THEN format('{:.1f}', n / 1024) || 'KB' ELSE format('{:.1f}', n / 1048576) || 'MB' END AS size,
        regexp_replace(url, '[^a-zA-Z0-9_.\\s-]', '', 'g') AS safe, regexp_matches(url, '^[a-zA-Z0-9_.-]+$') AS is_id
    FROM (SELECT *, page_id * 997 AS n FROM pages)""",
)
def display_helpers(spark, sf_dir):
    n = F.col("page_id") * 997
    return table(spark, sf_dir, "pages").select("page_id", X.short_name(F.col("url")).alias("short"), X.file_size(n).alias("size"), X.safe_file_name(F.col("url")).alias("safe"), X.is_safe_id(F.col("url")).alias("is_id"))


@register(
    "age_labels",
    """SELECT event_id, CASE WHEN s >= 604800 THEN strftime(ts, '%b %-d, %Y') WHEN s < 0 THEN '1 second ago'
        WHEN s < 60 THEN s || CASE WHEN s > 1 THEN ' seconds ago' ELSE ' second ago' END
        WHEN floor(s / 60 + 0.5) < 60 THEN floor(s / 60 + 0.5)::BIGINT || CASE WHEN floor(s / 60 + 0.5) > 1 THEN ' minutes ago' ELSE ' minute ago' END
        WHEN floor(s / 3600 + 0.5) < 24 THEN floor(s / 3600 + 0.5)::BIGINT || CASE WHEN floor(s / 3600 + 0.5) > 1 THEN ' hours ago' ELSE ' hour ago' END
        ELSE floor(s / 86400 + 0.5)::BIGINT || CASE WHEN floor(s / 86400 + 0.5) > 1 THEN ' days ago' ELSE ' day ago' END END AS age
    FROM (SELECT event_id, ts, epoch(TIMESTAMP '2024-01-12 00:00:00')::BIGINT - floor(epoch(ts))::BIGINT AS s FROM events)""",
)
def age_labels(spark, sf_dir):
    then = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", X.age(then, F.lit("2024-01-12 00:00:00").cast("timestamp")).alias("age"))


@register("json_get", "SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_get(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_LOOSE = "CASE event_id % 5 WHEN 0 THEN '  -12abc' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN event_id::VARCHAR || '.50' ELSE ' ' || event_id || ' ' END"


@register(
    "parse_int",
    rf"""SELECT event_id, try_cast(nullif(regexp_extract(v, '^\s*([+-]?\d+)', 1), '') AS BIGINT) AS n, try_cast(nullif(trim(v), '') AS DOUBLE) AS x,
        coalesce(nullif(v, ''), 'none') AS filled FROM (SELECT event_id, {_LOOSE} AS v FROM events)""",
)
def parse_int(spark, sf_dir):
    event = F.col("event_id").cast("string")
    loose = F.when(F.col("event_id") % 5 == 0, "  -12abc").when(F.col("event_id") % 5 == 1, "abc").when(F.col("event_id") % 5 == 2, "").when(F.col("event_id") % 5 == 3, F.concat(event, F.lit(".50"))).otherwise(F.concat(F.lit(" "), event, F.lit(" ")))
    return table(spark, sf_dir, "events").select("event_id", V.leading_integer(loose).alias("n"), V.number(loose).alias("x"), V.or_else(loose, F.lit("none")).alias("filled"))


@register(
    "boolean_table",
    """SELECT doc_id, coalesce(q = '1', false) AS one, CASE WHEN w IS NULL THEN false WHEN trim(lower(w)) IN ('false', 'no', '0', '') THEN false ELSE true END AS word,
        coalesce(toxic <> 0, false) AS toxic
    FROM (SELECT doc_id, quality::VARCHAR AS q, toxic, CASE doc_id % 5 WHEN 0 THEN ' No ' WHEN 1 THEN 'yes' WHEN 2 THEN '' WHEN 3 THEN 'maybe' END AS w FROM labels)""",
)
def boolean_table(spark, sf_dir):
    word = F.when(F.col("doc_id") % 5 == 0, " No ").when(F.col("doc_id") % 5 == 1, "yes").when(F.col("doc_id") % 5 == 2, "").when(F.col("doc_id") % 5 == 3, "maybe")
    return table(spark, sf_dir, "labels").select("doc_id", V.is_one(F.col("quality").cast("string")).alias("one"), V.flag(word).alias("word"), V.flag_of_number(F.col("toxic")).alias("toxic"))


@register(
    "iso_date",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS iso, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') AS compact,
        CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%gZ') END AS feed FROM orders""",
)
def iso_date(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    feed = F.when(F.col("o_orderkey") % 7 == 0, "0000-00-00 00:00:00").otherwise(F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.iso(day).alias("iso"), V.iso_date(F.date_format(day, "yyyyMMdd'T'HHmmss'Z'")).alias("compact"), V.feed_date(feed).alias("feed"))


PRIORITIES = (("1", "1-URGENT"), ("2", "2-HIGH"), ("3", "3-MEDIUM"))


@register(
    "enum_lookup",
    "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'default' END AS by_value, coalesce(v.value, 'default') AS by_key FROM orders LEFT JOIN (VALUES ('1', '1-URGENT'), ('2', '2-HIGH'), ('3', '3-MEDIUM')) v(key, value) ON v.key = substr(o_orderpriority, 1, 1)",
)
def enum_lookup(spark, sf_dir):
    options = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in PRIORITIES])
    of = lambda c: V.choice(options, c, F.lit("default"))
    return table(spark, sf_dir, "orders").select("o_orderkey", of(F.col("o_orderpriority")).alias("by_value"), of(F.substring("o_orderpriority", 1, 1)).alias("by_key"))


@register(
    "kv_wrap",
    """SELECT n_nationkey, '[{"key":"name","value":"' || n_name || '"},{"key":"region","value":"' || n_regionkey || '"}]' AS wrapped,
        n_name || '|own' AS merged, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END::INTEGER AS n_array FROM nation""",
)
def kv_wrap(spark, sf_dir):
    row = F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"), F.lit("name"), F.col("n_name"))
    merged = V.last_wins(F.create_map(F.lit("a"), F.col("n_name"), F.lit("b"), F.lit("old")), F.create_map(F.lit("b"), F.lit("own")))
    one = F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(V.key_values(row)).alias("wrapped"), F.concat(merged["a"], F.lit("|"), merged["b"]).alias("merged"), F.size(V.as_array(one)).alias("n_array"))


@register(
    "array_helpers",
    """SELECT o_orderkey, array_to_string(list_sort(n), ',') AS lines, list_sort(n)[len(n) // 2 + 1] AS median,
        array_to_string(CASE WHEN len(n) > 1 THEN list_sort(n)[2:] || list_sort(n)[:1] ELSE list_sort(n) END, ',') AS moved, len(list_distinct(f))::INTEGER AS n_flags
    FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber) AS n, list(l_returnflag) AS f FROM lineitem GROUP BY 1)""",
)
def array_helpers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"), F.collect_list("l_returnflag").alias("f"))
    last = F.concat(F.slice("n", F.lit(2), F.greatest(F.size("n") - 1, F.lit(0))), F.slice("n", 1, 1))
    return lines.select("o_orderkey", F.array_join("n", ",").alias("lines"), V.upper_median(F.col("n")).alias("median"), F.array_join(F.when(F.size("n") > 1, last).otherwise(F.col("n")), ",").alias("moved"), F.size(V.union_distinct(F.col("f"), F.array().cast("array<string>"))).alias("n_flags"))


@register(
    "component_names",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(t, 'components(?:/[a-zA-Z0-9_-]+)+', 0), ''), t) AS component,
        CASE WHEN contains(t, '/title') THEN 'title' WHEN contains(t, '/textbanner') THEN 'textbanner' WHEN contains(t, '/text') THEN 'text' WHEN contains(t, '/image') THEN 'image' END AS kind
    FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'site/components/content/title' WHEN 1 THEN 'site/components/textbanner' WHEN 2 THEN 'plain/text' ELSE 'site/components/x/image' END AS t FROM pages)""",
)
def component_names(spark, sf_dir):
    from marlstream.operators.classify import component_kind

    kind = F.when(F.col("page_id") % 4 == 0, "site/components/content/title").when(F.col("page_id") % 4 == 1, "site/components/textbanner").when(F.col("page_id") % 4 == 2, "plain/text").otherwise("site/components/x/image")
    return table(spark, sf_dir, "pages").select("page_id", X.component_name(kind).alias("component"), component_kind(kind, F.lit("h2")).alias("kind"))


@register(
    "affix_checks",
    "SELECT c_custkey, regexp_matches(a, '^[a-zA-Z][a-zA-Z0-9]{1,4}$') AS server, a || '_x' AS made FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(c_mktsegment, 1, 5) ELSE substr(c_name, 1, 9) END AS a FROM customer)",
)
def affix_checks(spark, sf_dir):
    affix = F.when(F.col("c_custkey") % 2 == 0, F.substring("c_mktsegment", 1, 5)).otherwise(F.substring("c_name", 1, 9))
    return table(spark, sf_dir, "customer").select("c_custkey", X.is_affix(affix).alias("server"), F.concat(affix, F.lit("_x")).alias("made"))
