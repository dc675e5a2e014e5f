"""Content-specific compositions: feeds, locales, references, field models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstream.functions import values as V
from marlstream.operators import merge
from marlstream.session import dropped, stored

#: fixed values: category domain of a feed -> content type
DOMAINS = {"category": "categories", "post_tag": "tag", "term": "terms"}
GUID = r"\{[A-Fa-f0-9-]{36}\}"


def category_references(items: DataFrame, item_id: str, index: DataFrame) -> DataFrame:
    """(item_id, refs) of a feed's items: their categories looked up in index (slug, content_type, uid), in order."""
    each = items.select(item_id, F.posexplode("category").alias("pos", "c")).where(F.col("c._nicename").isNotNull() & F.col("c._domain").isin(*DOMAINS))
    known = F.create_map(*[F.lit(x) for pair in DOMAINS.items() for x in pair])
    each = each.select(item_id, "pos", F.col("c._nicename").alias("slug"), known[F.col("c._domain")].alias("content_type"))
    first = merge.first_wins(index.select("slug", "content_type", "uid"), ["slug", "content_type"], "uid")
    hit = each.join(first, ["slug", "content_type"])
    return hit.groupBy(item_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "uid", "content_type"))), lambda x: F.struct(x["uid"].alias("uid"), x["content_type"].alias("content_type"))).alias("refs"))


def by_author(items: DataFrame, creator: str, authors: DataFrame, title: str) -> DataFrame:
    """Items with every author whose title is the creator's, commas and outer spaces aside."""
    return items.withColumn("__key", F.trim(F.replace(creator, F.lit(","), F.lit("")))).join(authors.withColumn("__key", F.trim(title)), "__key").drop("__key")


def featured(items: DataFrame, item_id: str, meta: str, assets: DataFrame, name: str = "_thumbnail_id") -> DataFrame:
    """(item_id, asset uid): the first postmeta of that name that an asset has."""
    each = items.select(item_id, F.posexplode(meta).alias("pos", "m")).where(F.col("m.`wp:meta_key`") == name).select(item_id, "pos", F.concat(F.lit("assets_"), F.col("m.`wp:meta_value`")).alias("uid"))
    return each.join(assets.select("uid"), "uid").groupBy(item_id).agg(F.min_by("uid", "pos").alias("uid"))


def guids(text: Column) -> Column:
    """Identifiers in braces, in order, without braces and hyphens, lower-cased."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({GUID})"), 1), lambda x: F.lower(F.regexp_replace(x, "[-{}]", "")))


def page_locale(language: Column, path: Column, mapping: dict[str, str], master: str) -> Column:
    """Destination locale of a page: its language, or else its path's last segment, by the mapping; the master locale
    for what the mapping lacks."""
    own = V.or_else(language, F.element_at(F.split(path, "/"), -1))
    known = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.try_element_at(known, own), F.lit(master))


def locale_table(codes: DataFrame, code: str, names: DataFrame, master: str) -> DataFrame:
    """(code, name, fallback_locale): every locale falls back to the master, which has none."""
    return codes.select(F.col(code).alias("code")).distinct().join(names.select("code", "name"), "code", "left").select("code", F.coalesce("name", "code").alias("name"), F.when(F.col("code") != master, F.lit(master)).alias("fallback_locale"))


def with_required(fields: DataFrame, keys: list[str], required: dict[str, str]) -> DataFrame:
    """Fields (keys, uid, type, pos), with the required ones put in front of each model that lacks them."""
    rows = F.array(*[F.struct(F.lit(u).alias("uid"), F.lit(t).alias("type"), F.lit(i - len(required)).alias("pos")) for i, (u, t) in enumerate(required.items())])
    wanted = fields.select(*keys).distinct().select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")
    return fields.unionByName(wanted.join(fields, [*keys, "uid"], "left_anti"))


def merged_models(fields: DataFrame, model: str, uid: str, pos: str, kind: str) -> DataFrame:
    """Models of one id from several files become one: each field once, at the upper median of its positions, with the
    first kind that is given."""
    return fields.groupBy(model, uid).agg(
        V.upper_median(F.collect_list(pos)).alias(pos),
        F.min(F.when(F.col(kind).isNotNull(), F.struct(pos, kind)))[kind].alias(kind),
        F.count("*").alias("n_files"),
    )


def merged_blocks(blocks: DataFrame, model: str, uid: str, pos: str, signature: str) -> DataFrame:
    """(model, uid, blocks): the blocks of one id with different signatures, as they first appear."""
    first = blocks.groupBy(model, uid, signature).agg(F.min(pos).alias(pos))
    return first.groupBy(model, uid).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, signature))), lambda x: x[signature]).alias("blocks"))


def ancestors(nodes: DataFrame, uid: str, parent: str) -> DataFrame:
    """(uid, ancestor, distance) of a parent table, by doubling: a round joins the shortest paths of exactly d steps with those
    of up to d, which gives those of up to 2 d, so a tree of depth d takes log2(d) rounds. Of a tree each pair is made once: were paths
    of up to d joined with each other, a pair would be made for each of its steps, and all that is below a root would meet in
    one task. A cycle ends when no shortest path is as long as d."""
    known = stored(nodes.where(F.col(parent).isNotNull()).select(F.col(uid).alias("uid"), F.col(parent).alias("ancestor"), F.lit(1).cast("long").alias("distance")).distinct())
    steps = 1
    while not (longest := known.where(F.col("distance") == steps)).isEmpty():
        further = known.select(F.col("uid").alias("ancestor"), F.col("ancestor").alias("above"), F.col("distance").alias("more"))
        longer = longest.join(further, "ancestor").select("uid", F.col("above").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        last, known = known, stored(known.unionByName(longer).groupBy("uid", "ancestor").agg(F.min("distance").alias("distance")))
        dropped(last)
        steps *= 2
    return known


def inferred_schema(rows: DataFrame, group: list[str], column: str) -> DataFrame:
    """(group, schema, sample): the common schema of a JSON column and its first value, for each group."""
    return rows.groupBy(*group).agg(F.schema_of_variant_agg(F.try_parse_json(column)).alias("schema"), F.min(column).alias("sample"))
