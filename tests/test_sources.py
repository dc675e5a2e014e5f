from __future__ import annotations

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstream.operators import feed, metadata
from marlstream.sources.keyed import KeyedTable
from marlstream.sources import files, sinks
from marlstream.sources.paged import PagedSource
from marlstream.streaming import logs

FEED = """<?xml version="1.0"?><!-- c --><rss xmlns:wp="w" xmlns:dc="d" xmlns:content="c"><channel>
<item><title>A</title><wp:post_type>post</wp:post_type><wp:status>publish</wp:status><category domain="category" nicename="x">X</category><category domain="post_tag" nicename="y">Y</category></item>
<item><title></title><wp:post_type>page</wp:post_type><wp:status>draft</wp:status></item>
<item><title>C</title><wp:status>inherit</wp:status></item>
<item><title>D</title><wp:post_type>attachment</wp:post_type><wp:status>inherit</wp:status><wp:attachment_url>u</wp:attachment_url></item>
<item><title>E</title><wp:post_type>post</wp:post_type><wp:status>trash</wp:status></item></channel></rss>"""


def test_feed(spark, tmp_path):
    (tmp_path / "f.xml").write_text(FEED)
    items = files.feed_items(spark, str(tmp_path / "f.xml"))
    titles = lambda df: sorted(r.title or "" for r in df.collect())
    assert titles(files.posts(items)) == ["A", "C"] and titles(files.pages(items)) == [""] and titles(files.attachments(items)) == ["D"]
    assert [(c.text, c._nicename) for c in items.where("title = 'A'").first().category] == [("X", "x"), ("Y", "y")]


EXPORT = """<?xml version="1.0"?><rss xmlns:wp="w" xmlns:dc="d" xmlns:content="c" xmlns:excerpt="e"><channel>
<item><title>First</title><dc:creator>Ann, Lee</dc:creator><content:encoded><![CDATA[<p>One <b>bold</b></p>]]></content:encoded><wp:post_id>1</wp:post_id><wp:post_name>first-post</wp:post_name><wp:post_date_gmt>2024-01-02 03:04:05</wp:post_date_gmt><wp:post_type>post</wp:post_type><wp:status>publish</wp:status>
<category domain="category" nicename="big-news">Big News</category><category domain="post_tag" nicename="x">X</category><wp:postmeta><wp:meta_key>_thumbnail_id</wp:meta_key><wp:meta_value>9</wp:meta_value></wp:postmeta></item>
<item><title></title><dc:creator>Nobody</dc:creator><wp:post_id>2</wp:post_id><wp:post_date_gmt>0000-00-00 00:00:00</wp:post_date_gmt><wp:post_type>page</wp:post_type><wp:status>draft</wp:status></item>
<item><title>Pic</title><wp:post_id>9</wp:post_id><wp:post_type>attachment</wp:post_type><wp:status>inherit</wp:status><wp:attachment_url>https://x.io/p/pic.png</wp:attachment_url></item>
<item><title>Gone</title><wp:post_id>7</wp:post_id><wp:post_type>post</wp:post_type><wp:status>trash</wp:status></item></channel></rss>"""


def test_feed_from_package_to_entries(spark, tmp_path):
    (tmp_path / "f.xml").write_text(EXPORT)
    found = feed.entries(spark, str(tmp_path / "f.xml"), ["en-us", "de-de"])
    by_locale = {locale: {r.uid: (r.content_type, json.loads(r.entry)) for r in found.collect() if r.locale == locale} for locale in ("en-us", "de-de")}
    assert by_locale["en-us"] == by_locale["de-de"] and {k: v[0] for k, v in by_locale["en-us"].items()} == {
        "posts_1": "posts", "pages_2": "pages", "authors_ann_lee": "authors", "authors_nobody": "authors", "categories_big_news": "categories", "tag_x": "tag", "assets_9": "assets",
    }
    post = by_locale["en-us"]["posts_1"][1]
    body = post.pop("full_description")
    assert post == {
        "title": "First", "uid": "posts_1", "url": "/first-post", "date": "2024-01-02T03:04:05.000Z", "excerpt": "One bold", "featured_image": "assets_9", "author": [{"uid": "authors_ann_lee", "_content_type_uid": "authors"}],
        "terms": [{"uid": "categories_big_news", "_content_type_uid": "categories"}, {"uid": "tag_x", "_content_type_uid": "tag"}],
    }
    assert "bold" in json.dumps(body) and body["type"] == "doc"
    page = by_locale["en-us"]["pages_2"][1]
    assert (page["title"], page["url"], page["terms"]) == ("Untitled - 2", "/pages_2", []) and "date" not in page and "featured_image" not in page
    assert by_locale["en-us"]["assets_9"][1] == {"uid": "assets_9", "title": "Pic", "url": "https://x.io/p/pic.png", "name": "pic.png", "urlPath": "/assets/assets_9"}
    sinks.entries(found, str(tmp_path / "out"))
    assert sorted(r.n_rows for r in sinks.manifest(found).collect()) == [1, 1, 1, 1, 1, 1, 1, 1, 1, 1, 2, 2] and spark.read.json(str(tmp_path / "out")).count() == 14


def test_sections(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps({"locales": [{"code": "en"}, {"code": "de"}], "entries": []}))
    found = files.sections(spark, str(tmp_path / "e.json"), ["locales", "webhooks"], "locales array<struct<code:string>>, entries array<string>")
    assert [(r.pos, r.code) for r in found["locales"].collect()] == [(0, "en"), (1, "de")] and found["webhooks"].count() == 0


def test_page_models_and_trees(spark, tmp_path):
    for name, text in {"a/p.json": {"templateName": "t", ":items": {}}, "a/dam-downloads/x.json": {"a": 1}, "b/q.json": [1], "b/data.json": {"k": 1}, "b/__Prototypes/data.json": {"k": 2}}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(json.dumps(text))
    (tmp_path / "a/broken.json").write_text("{no")
    models = files.page_models(spark, str(tmp_path))
    assert sorted(r.path.rsplit("/", 1)[1] for r in models.collect()) == ["data.json", "p.json"]  # Spark hides folders that begin with an underscore
    assert files.is_page_package(models).first().valid and not files.is_page_package(models.where("path LIKE '%data%'")).first().valid
    assert files.item_tree(spark, str(tmp_path)).count() == 1
    assert [r.name for r in files.find_files(spark, str(tmp_path), pattern=r"^p\.json$").collect()] == ["p.json"]


def test_archives(spark, tmp_path):
    inner, outer = io.BytesIO(), tmp_path / "o.zip"
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("metadata/m.txt", "m")
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("items/a.txt", "a"), z.writestr("__MACOSX/b", "b"), z.writestr("in.zip", inner.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    entries = files.archive_entries(spark, str(tmp_path))
    assert sorted(r.entry for r in entries.where("error IS NULL").collect()) == ["in.zip/metadata/m.txt", "items/a.txt"]
    (broken,) = entries.where("error IS NOT NULL").collect()
    assert broken.archive.endswith("bad.zip") and broken.entry is None and broken.content is None
    assert sorted(r.valid for r in files.has_folders(entries).collect()) == [False, True]


def test_archives_of_any_depth_and_broken_entries(spark, tmp_path):
    data = b"deep"
    for i in range(9):
        outer = io.BytesIO()
        with zipfile.ZipFile(outer, "w") as z:
            z.writestr(f"{i}.zip" if i else "d.txt", data)
        data = outer.getvalue()
    (tmp_path / "o.zip").write_bytes(data)
    whole = io.BytesIO()
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("good.txt", "good"), z.writestr("torn.txt", "torn")
    (tmp_path / "torn.zip").write_bytes(whole.getvalue().replace(b"torn", b"TORN", 2).replace(b"TORN.txt", b"torn.txt"))
    found = {(r.entry, bytes(r.content) if r.content else None, r.error is None) for r in files.archive_entries(spark, str(tmp_path)).collect()}
    assert ("8.zip/7.zip/6.zip/5.zip/4.zip/3.zip/2.zip/1.zip/d.txt", b"deep", True) in found
    assert ("good.txt", b"good", True) in found and len(found) == 3


def test_logs_and_audits(spark):
    lines = ["Log file created", '{"level":"info","message":"m","timestamp":"2024-01-01T00:00:00Z"}', '{"level":"error","message":{"methodName":"f","message":"x"},"timestamp":"t"}', "[1]", ""]
    rows = files.log_rows(spark.createDataFrame([(x,) for x in lines], "value string")).orderBy("level").collect()
    assert [(r.level, r.message, r.methodName) for r in rows] == [("error", "x", "f"), ("info", "m", None)]
    reports = spark.createDataFrame([('[{"uid":"u"},{"a":1}]',), ('{"k":[{"b":1}],"o":{"uid":"z"}, "s": 1}',), (None,)], "value string")
    assert sorted(r.uid for r in files.audit_rows(reports).collect()) == ["item-1", "k-0", "u", "z"]


PROVIDER = """def provide(options, offset, limit):
    return [{"n": i} for i in range(offset, min(offset + limit, 25))]
"""


@pytest.fixture(scope="module")
def provider(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("provider") / "page_provider_for_tests.py"
    path.write_text(PROVIDER)
    spark.sparkContext.addPyFile(str(path))
    spark.dataSource.register(PagedSource)
    return "page_provider_for_tests:provide"


@pytest.mark.parametrize("options", [{"total": "25"}, {}])
def test_paged(spark, provider, options):
    df = spark.read.format("marlstream_paged").option("provider", provider).option("limit", "10").options(**options).load()
    assert sorted(json.loads(r.row)["n"] for r in df.collect()) == list(range(25))


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, "p" if i % 2 else "q", "en", "x" * 100) for i in range(250)], "uid int, content_type string, locale string, body string")
    sinks.entries(df, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 250 and {r.n_rows for r in sinks.manifest(df).collect()} == {125}
    sinks.chunked(df, str(tmp_path / "c"), ["uid"], by_bytes=False)
    assert sorted(r["count"] for r in spark.read.json(str(tmp_path / "c")).groupBy("chunk").count().collect()) == [50, 100, 100]
    df.select("uid", "body").write.parquet(str(tmp_path / "t"))
    sinks.upsert(spark.createDataFrame([(1, "new"), (999, "new")], "uid int, body string"), str(tmp_path / "t"), ["uid"])
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("t.")] == []
    table = spark.read.parquet(str(tmp_path / "t"))
    assert table.count() == 251 and table.where("body = 'new'").count() == 2
    sinks.replicated(df, str(tmp_path / "r"), ["de", "fr"])
    assert spark.read.json(str(tmp_path / "r")).count() == 500


def test_ingest(spark):
    packages = spark.createDataFrame([("p", "P", [("a", "text"), ("b", "number")]), ("q", "Q", [])], "uid string, title string, fields array<struct<uid:string,type:string>>")
    types, fields = metadata.ingest(packages, "x")
    listed = {r.content_type: r.field_mapping for r in types.collect()}
    ids = {r.uid: r.id for r in fields.collect()}
    assert listed == {"p": [ids["a"], ids["b"]], "q": None}
    flags = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, is_deleted boolean")
    assert metadata.alive(flags).count() == 2 and metadata.alive(flags, missing_is_alive=False).count() == 1


def test_tail(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    line = lambda level, minute, text: json.dumps({"level": level, "message": text, "timestamp": f"2024-01-01T00:{minute:02d}:00Z"}) + "\n"
    (source / "a.log").write_text("Log file created\n" + line("info", 0, "a") + line("error", 1, "b"))
    run = lambda: logs.append_to(logs.tail(spark, str(source)), str(out), str(tmp_path / "cp"), available_now=True).awaitTermination()
    run()
    (source / "b.log").write_text(line("info", 2, "c"))
    run()
    assert sorted(r.message for r in spark.read.json(str(out)).collect()) == ["a", "b", "c"]
    rows = logs.tail(spark, str(source)).select("timestamp", F.lit("k").alias("level"), "message")
    logs.merged_into(rows, str(tmp_path / "latest"), str(tmp_path / "cp2"), ["level"], available_now=True).awaitTermination()
    assert [r.message for r in KeyedTable(spark, str(tmp_path / "latest"), ["level"], latest="timestamp").read().collect()] == ["c"]
    query = logs.level_counts(logs.tail(spark, str(source)), delay="0 seconds").writeStream.format("memory").queryName("levels").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {(r.level, r.n) for r in spark.table("levels").collect()} == {("info", 1), ("error", 1)}


def test_pushed_with_retries(spark, tmp_path):
    """A batch that is refused once is taken the second time; one that is always refused is told."""
    folder = str(tmp_path)

    def send(texts):
        import pathlib

        if '{"k":13}' in texts:
            raise ValueError("refused")
        seen = pathlib.Path(folder, "seen-" + texts[0].replace('"', ""))
        if not seen.exists():
            seen.touch()
            raise ConnectionError("not yet")

    found = sinks.pushed(spark.range(20).coalesce(1).select(F.col("id").alias("k")), send, rows=5, attempts=3, wait=0.01).collect()
    assert len(found) == 20 and {json.loads(r.row)["k"] for r in found if r.error} == {10, 11, 12, 13, 14}
    assert {r.attempts for r in found if r.error} == {3} and {r.attempts for r in found if not r.error} == {2} and "ValueError: refused" in found[10].error
