"""A feed export from its package to entries by content type and locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstream.functions import documents, text as X
from marlstream.functions import values as V
from marlstream.operators import content, lookup
from marlstream.sources import files


def terms(items: DataFrame) -> DataFrame:
    """(content_type, slug, uid, title) of the categories, tags and terms that items name; a slug's first title by name."""
    known = F.create_map(*[F.lit(x) for pair in content.DOMAINS.items() for x in pair])
    each = items.select(F.explode("category").alias("c")).where(F.col("c._domain").isin(*content.DOMAINS) & F.col("c._nicename").isNotNull())
    rows = each.select(known[F.col("c._domain")].alias("content_type"), F.col("c._nicename").alias("slug"), F.col("c.text").alias("title"))
    return rows.groupBy("content_type", "slug").agg(F.min("title").alias("title")).withColumn("uid", F.concat_ws("_", "content_type", X.flat_uid(F.col("slug"))))


def authors(items: DataFrame) -> DataFrame:
    """(uid, title) of those who wrote items."""
    return items.select(F.trim(F.replace("dc:creator", F.lit(","), F.lit(""))).alias("title")).where("title <> ''").distinct().withColumn("uid", F.concat(F.lit("authors_"), X.flat_uid(F.col("title"))))


def assets(items: DataFrame) -> DataFrame:
    """(uid, title, url, name, urlPath) of attachments, one for each id."""
    own = files.attachments(items).where("`wp:attachment_url` IS NOT NULL AND `wp:post_id` IS NOT NULL").groupBy("wp:post_id").agg(F.min(F.struct("wp:attachment_url", "title")).alias("x"))
    url = F.col("x.`wp:attachment_url`")
    uid = F.concat(F.lit("assets_"), F.col("wp:post_id"))
    return own.select(uid.alias("uid"), F.coalesce(F.nullif(F.trim("x.title"), F.lit("")), X.file_name(url)).alias("title"), url.alias("url"), X.file_name(url).alias("name"), F.concat_ws("/", F.lit("/assets"), uid).alias("urlPath"))


def _bodies(items: DataFrame, kind: str, known_authors: DataFrame, known_terms: DataFrame, known_assets: DataFrame) -> DataFrame:
    """(uid, entry) of posts or pages: their fields as JSON. Items of one id are one entry, the first by title."""
    rows = items.where("`wp:post_id` IS NOT NULL").groupBy("wp:post_id").agg(F.min_by(F.struct("*"), F.struct("title", "wp:post_name")).alias("x")).select("x.*")
    number, uid = F.col("wp:post_id"), F.concat(F.lit(f"{kind}_"), F.col("wp:post_id"))
    wrote = content.by_author(rows, "dc:creator", known_authors.select(F.col("title").alias("__author"), F.col("uid").alias("__author_uid")), "__author").select(number.alias("__id"), F.array(F.struct(F.col("__author_uid").alias("uid"), F.lit("authors").alias("_content_type_uid"))).alias("__authors"))
    filed = content.category_references(rows, "wp:post_id", known_terms).select(F.col("wp:post_id").alias("__id"), F.transform("refs", lambda r: F.struct(r["uid"].alias("uid"), r["content_type"].alias("_content_type_uid"))).alias("__terms"))
    shown = content.featured(rows, "wp:post_id", "wp:postmeta", known_assets).select(F.col("wp:post_id").alias("__id"), F.col("uid").alias("__image"))
    for more in (wrote, filed, shown):
        rows = rows.join(more, number == F.col("__id"), "left").drop("__id")
    body = F.coalesce("content:encoded", F.lit(""))
    entry = F.struct(
        F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.concat(F.lit("Untitled - "), number)).alias("title"), uid.alias("uid"),
        F.concat(F.lit("/"), F.coalesce(F.nullif(F.lower("wp:post_name"), F.lit("")), uid)).alias("url"), V.feed_date(F.col("wp:post_date_gmt")).alias("date"),
        F.parse_json(documents.html_to_tree(body)).alias("full_description"), F.coalesce(F.nullif(F.trim("excerpt:encoded"), F.lit("")), X.truncated(X.html_text(body))).alias("excerpt"),
        F.coalesce("__authors", _none()).alias("author"), F.coalesce("__terms", _none()).alias("terms"), F.col("__image").alias("featured_image"),
    )
    return rows.select(uid.alias("uid"), F.to_json(entry).alias("entry"))


def _none() -> Column:
    return F.array().cast("array<struct<uid:string,_content_type_uid:string>>")


def entries(spark: SparkSession, path: str, locales: list[str]) -> DataFrame:
    """(content_type, locale, uid, entry) of a feed export: posts and pages with their authors, terms and featured images as
    references, then authors, terms and assets, each in every locale of the master's list, the first being the master."""
    items = files.feed_items(spark, path)
    known = authors(items), terms(items), assets(items)
    record = lambda df, kind: df.select(kind.alias("content_type"), "uid", F.to_json(F.struct(*[c for c in df.columns if c != "content_type"])).alias("entry"))
    made = [_bodies(own, kind, *known).select(F.lit(kind).alias("content_type"), "uid", "entry") for kind, own in (("posts", files.posts(items)), ("pages", files.pages(items)))]
    made += [record(known[0], F.lit("authors")), record(known[1], F.col("content_type")), record(known[2], F.lit("assets"))]
    whole = made[0]
    for more in made[1:]:
        whole = whole.unionByName(more)
    return lookup.replicated(whole, locales).select("content_type", "locale", "uid", "entry")
