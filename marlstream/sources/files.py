"""Scans of source packages: XML feeds, item trees, one-document JSON exports, page models, archives, logs, audit files.

Paths may be anything that Spark's readers open (local, s3a://, ...). Nothing is read on the driver.
"""

from __future__ import annotations

import io
import shutil
import tempfile
import zipfile
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstream.functions import markup

#: bytes of an archive inside an archive that stay in memory; beyond them it goes through a task's temporary file
NESTED_BYTES = 32 << 20


def xml_rows(spark: SparkSession, path: str, row_tag: str = "item", schema: T.StructType | str | None = None, mode: str = "DROPMALFORMED") -> DataFrame:
    """One row for each `row_tag` element; attributes start with an underscore, text is in `text`, comments and
    declarations are ignored. Broken elements are left out, or with mode PERMISSIVE kept as far as they can be read;
    repeated children are arrays by the schema."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "_").option("valueTag", "text").option("mode", mode).option("inferSchema", "false")
    return (reader.schema(schema) if schema else reader).load(path)


def repaired_rows(spark: SparkSession, path: str, row_tag: str = "item", schema: T.StructType | str | None = None) -> DataFrame:
    """One row for each `row_tag` element of broken XML: each is cut out, repaired and then parsed by the schema. The file is split at
    the ends of its rows, so one of any size is read by many tasks; a row that isn't closed ends where the next begins or the
    file does. What is between rows is left out. Rows must not hold rows, nor
    their tags in CDATA, nor end tags in comments."""
    pieces = spark.read.option("lineSep", f"</{row_tag}>").text(path).select(F.regexp_replace("value", r"(?s)<!--.*?-->", "").alias("value"))
    # what begins with a row's start tag; before the first of a piece is what was between rows
    begins = F.split("value", rf"(?=<{row_tag}[\s/>])")
    rows = pieces.select(F.explode(begins).alias("broken")).where(F.col("broken").rlike(rf"^<{row_tag}[\s/>]"))
    # an unclosed last row also holds the ends of what is around it, which close nothing in it
    return rows.select(F.from_xml(markup.repaired_xml(F.col("broken")), schema, {"attributePrefix": "_", "valueTag": "text", "rowTag": row_tag}).alias("x")).select("x.*")


#: a feed export's rows; every leaf is a text
FEED_ITEM = """title string, link string, `dc:creator` string, description string, `content:encoded` string, `excerpt:encoded` string, `wp:post_id` string, `wp:post_name` string,
    `wp:post_date_gmt` string, `wp:post_type` string, `wp:status` string, `wp:post_parent` string, `wp:attachment_url` string,
    category array<struct<text: string, _domain: string, _nicename: string>>, `wp:postmeta` array<struct<`wp:meta_key`: string, `wp:meta_value`: string>>"""


def feed_items(spark: SparkSession, path: str, repair: bool = False) -> DataFrame:
    return repaired_rows(spark, path, "item", FEED_ITEM) if repair else xml_rows(spark, path, "item", FEED_ITEM)


def posts(items: DataFrame) -> DataFrame:
    """Items that are neither pages nor attachments; a missing type counts as a post."""
    kind = F.coalesce("wp:post_type", F.lit(""))
    return items.where(~kind.isin("page", "attachment") & F.col("wp:status").isin("publish", "inherit", "draft"))


def pages(items: DataFrame) -> DataFrame:
    return items.where((F.col("wp:post_type") == "page") & F.col("wp:status").isin("publish", "inherit", "draft"))


def attachments(items: DataFrame) -> DataFrame:
    return items.where(F.col("wp:post_type") == "attachment")


def sections(spark: SparkSession, path: str, names: list[str], schema: str | None = None) -> dict[str, DataFrame]:
    """The arrays of a one-document JSON export, each exploded to rows; a missing section is an empty frame of ids."""
    reader = spark.read.option("multiLine", True)
    doc = (reader.schema(schema) if schema else reader).json(path)
    found = {}
    for name in names:
        if name in doc.columns:
            found[name] = doc.select(F.posexplode(name).alias("pos", "x")).select("pos", "x.*")
        else:
            found[name] = spark.createDataFrame([], "pos int, id string")
    return found


def page_models(spark: SparkSession, path: str, skip: str = "dam-downloads") -> DataFrame:
    """(path, model): one JSON text for each page-model file below a folder; asset downloads and files that aren't JSON
    objects are left out."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("model"))
    kept = files.where(~F.contains("path", F.lit(f"/{skip}/")))
    return kept.where(F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json("model")), F.lit("OBJECT")), F.lit(False)))


def package(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a source package by its ending: a feed, an archive's entries, one JSON document, or a folder's models."""
    ending = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if ending == "xml":
        return feed_items(spark, path)
    if ending == "zip":
        return archive_entries(spark, path)
    if ending == "json":
        return spark.read.option("multiLine", True).json(path)
    return page_models(spark, path)


def find_files(spark: SparkSession, path: str, pattern: str | None = None, text: str | None = None) -> DataFrame:
    """(path, name, length) of files below a folder whose name fits a pattern or contains a text. Contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.substring_index("path", "/", -1).alias("name"), "length")
    if pattern is not None:
        files = files.where(F.col("name").rlike(pattern))
    return files.where(F.contains("name", F.lit(text))) if text is not None else files


def item_tree(spark: SparkSession, path: str, skip: tuple[str, ...] = ("__Standard Values", "__Prototypes", "__Masters", "blob", "media library")) -> DataFrame:
    """(path, item) of an item tree's data files; skipped folders are pruned by their names."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "data.json").option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("item"))
    folder = F.replace("path", F.lit("%20"), F.lit(" "))
    for name in skip:
        files = files.where(~F.contains(folder, F.lit(f"/{name}/")))
    return files


def _unpacked(data: bytes):
    """(entry, content, error) of an archive and those inside it, to any depth."""
    unread = (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError, OSError)
    open_ = [("", io.BytesIO(data))]
    while open_:
        prefix, source = open_.pop()
        try:
            archive = zipfile.ZipFile(source)
        except unread as e:
            yield prefix.rstrip("/") or None, None, str(e)
            continue
        for entry in archive.infolist():
            name = f"{prefix}{entry.filename}"
            if entry.is_dir() or entry.filename.startswith("__MACOSX"):
                continue
            try:
                if entry.filename.lower().endswith(".zip"):
                    inner = tempfile.SpooledTemporaryFile(NESTED_BYTES)  # noqa: SIM115
                    with archive.open(entry) as packed:
                        shutil.copyfileobj(packed, inner)
                    open_.append((f"{name}/", inner))
                else:
                    yield name, archive.read(entry), None
            except unread as e:
                yield name, None, str(e)
        source.close()


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """(archive, entry, content, error) of ZIP files, those inside ZIP files too, to any depth. What can't be read, as it is
    broken or encrypted, is a row with an error and no content; with a null entry it is the archive itself. An archive is a
    task's unit of work, and an entry is in memory at a time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for archive, data in zip(batch["path"], batch["content"], strict=True):
                for entry, content, error in _unpacked(data):
                    yield pd.DataFrame({"archive": [archive], "entry": [entry], "content": [content], "error": [error]}, dtype=object)

    return files.mapInPandas(run, "archive string, entry string, content binary, error string")


def has_folders(entries: DataFrame, folders: tuple[str, ...] = ("items", "metadata")) -> DataFrame:
    """(archive, valid): if an archive has every required folder somewhere on its paths."""
    parts = F.split("entry", "/")
    above = F.slice(parts, F.lit(1), F.size(parts) - 1)
    found = entries.groupBy("archive").agg(*[F.bool_or(F.coalesce(F.array_contains(above, f), F.lit(False))).alias(f"__{i}") for i, f in enumerate(folders)])
    return found.select("archive", reduce(Column.__and__, [F.col(f"__{i}") for i in range(len(folders))]).alias("valid"))


def is_page_package(models: DataFrame) -> DataFrame:
    """(valid): if any page model names a template and has items."""
    get = lambda path: F.get_json_object("model", path)
    named = get("$.templateType").isNotNull() | get("$.templateName").isNotNull() | F.contains(F.coalesce(get("$[':path']"), F.lit("")), F.lit("/experience-fragments/"))
    return models.agg(F.coalesce(F.bool_or(named & get("$[':items']").isNotNull()), F.lit(False)).alias("valid"))


LOG_LINE = "level string, message string, methodName string, timestamp string"


def log_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Log lines as rows; lines that aren't JSON objects are left out. A message may be a text or an object with the
    fields `methodName` and `message`."""
    parsed = F.try_parse_json(line)
    get = lambda path: F.try_variant_get(parsed, path, "string")
    rows = lines.withColumn("__ok", F.coalesce(F.startswith(F.schema_of_variant(parsed), F.lit("OBJECT")), F.lit(False))).where("__ok")
    inner = get("$.message.message")
    return rows.select(*[c for c in lines.columns if c != line], get("$.level").alias("level"), F.coalesce(inner, get("$.message")).alias("message"), F.coalesce(get("$.message.methodName"), get("$.methodName")).alias("methodName"), get("$.timestamp").alias("timestamp"))


def audit_rows(reports: DataFrame, column: str = "value") -> DataFrame:
    """Rows (parent_key, pos, uid, row) of an audit report, an array or a map of arrays or objects. A row without uid
    gets one of its place."""
    row = lambda x: F.get_json_object(x, "$.uid")
    text = F.trim(column)
    listed = reports.where(F.startswith(text, F.lit("["))).select(F.lit(None).cast("string").alias("parent_key"), F.posexplode(_json_array(F.col(column))).alias("pos", "row"))
    listed = listed.select("parent_key", "pos", F.coalesce(F.nullif(row("row"), F.lit("")), F.concat(F.lit("item-"), F.col("pos").cast("string"))).alias("uid"), "row")
    entries = reports.where(F.startswith(text, F.lit("{"))).select(F.explode(_json_object(F.col(column))).alias("parent_key", "cell"))
    many = entries.where(F.startswith("cell", F.lit("["))).select("parent_key", F.posexplode(_json_array(F.col("cell"))).alias("pos", "row"))
    many = many.select("parent_key", "pos", F.coalesce(F.nullif(row("row"), F.lit("")), F.concat("parent_key", F.lit("-"), F.col("pos").cast("string"))).alias("uid"), "row")
    one = entries.where(F.startswith("cell", F.lit("{"))).select("parent_key", F.lit(0).alias("pos"), F.coalesce(F.nullif(row("cell"), F.lit("")), F.col("parent_key")).alias("uid"), F.col("cell").alias("row"))
    return listed.unionByName(many).unionByName(one)


def _json_array(column: Column) -> Column:
    """The elements of a JSON array as JSON texts."""
    return F.transform(F.try_variant_get(F.try_parse_json(column), "$", "array<variant>"), lambda x: F.to_json(x))


def _json_object(column: Column) -> Column:
    """The members of a JSON object as JSON texts."""
    return F.transform_values(F.try_variant_get(F.try_parse_json(column), "$", "map<string,variant>"), lambda _, x: F.to_json(x))
