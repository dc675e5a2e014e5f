"""Changes of metadata tables, as DataFrames in and out: what is written, and where, is up to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_initial(rows: DataFrame, column: str, name: str = "initial") -> DataFrame:
    """Keeps the value at ingest beside the one that may be edited."""
    return rows.withColumn(name, F.col(column))


def update(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the changes' columns put in where their key is among the changes; a null change counts."""
    changed = [c for c in changes.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__hit"))
    joined = rows.join(new, keys, "left")
    return joined.select(*[F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in rows.columns])


def reset(rows: DataFrame, which: Column, backups: dict[str, str], flag: str = "is_updated") -> DataFrame:
    """Columns of the chosen rows go back to their backups, unless these are empty."""
    out = rows
    for column, backup in backups.items():
        out = out.withColumn(column, F.when(which, F.coalesce(F.nullif(F.col(backup), F.lit("")), F.col(column))).otherwise(F.col(column)))
    return out.withColumn(flag, F.when(which, False).otherwise(F.col(flag)))


def soft_delete(rows: DataFrame, which: Column, flag: str = "is_deleted") -> DataFrame:
    return rows.withColumn(flag, F.coalesce(which, F.lit(False)) | F.col(flag))


def alive(rows: DataFrame, flag: str = "is_deleted", missing_is_alive: bool = True) -> DataFrame:
    """Rows that aren't deleted; whether a missing flag counts as alive differs between the root and nested levels."""
    return rows.where(F.coalesce(~F.col(flag), F.lit(missing_is_alive)))


def cascade_delete(children: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return children.join(gone, key, "left_anti")


def ingest(packages: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """(content types, fields) from packages (uid, title, fields array<struct<uid,type>>): ids are stable hashes, and a
    content type holds the ordered ids of its fields."""
    fields = packages.select(F.col("uid").alias("content_type"), F.posexplode("fields").alias("pos", "f")).select(
        F.sha2(F.concat_ws("/", F.lit(project), "content_type", F.col("pos").cast("string")), 256).alias("id"), F.lit(project).alias("project_id"), "content_type", "pos", "f.uid", "f.type", F.col("f.type").alias("backup_type"),
    )
    listed = fields.groupBy("content_type").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("field_mapping"))
    types = packages.select(F.sha2(F.concat_ws("/", F.lit(project), "uid"), 256).alias("id"), F.lit(project).alias("project_id"), F.col("uid").alias("content_type"), "title", F.lit(False).alias("is_updated"), F.lit(1).alias("status"))
    return types.join(listed, "content_type", "left"), fields


#: fixed values: source module -> destination module, and the actions that `*` stands for
MODULES = {"ContentType": "content_types", "Entry": "content_types.entries", "Asset": "assets"}
ACTIONS = ("create", "update", "delete", "publish", "unpublish")


def channels(topics: Column) -> Column:
    """Destination channels of `Module.action` topics, distinct; `*` stands for all modules or actions."""
    text = lambda *x: F.array(*[F.lit(y) for y in x])

    def modules(topic):
        name = F.substring_index(topic, ".", 1)
        found = text()
        for source, target in MODULES.items():
            found = F.when(name == source, text(target)).otherwise(found)
        return F.when(name == "*", text(*MODULES.values())).otherwise(found)

    def actions(topic):
        act = F.substring_index(topic, ".", -1)
        return F.when(act == "*", text(*ACTIONS)).when(act == "save", text("update")).otherwise(F.array(act))

    def channel(module, act):
        return F.when(act.isin("publish", "unpublish"), F.concat(module, F.lit(".environments."), act, F.lit(".success"))).otherwise(F.concat(module, F.lit("."), act))

    made = F.transform(topics, lambda t: F.flatten(F.transform(modules(t), lambda m: F.transform(actions(t), lambda a: channel(m, a)))))
    return F.array_distinct(F.flatten(made))
