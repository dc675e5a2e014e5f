from __future__ import annotations

import json

from pyspark.sql import Row
from pyspark.sql import functions as F

from marlstream.functions import documents as D
from marlstream.functions import text as X
from marlstream.functions import values as V
from marlstream.operators import mapping as M
from marlstream.operators import trees, windows
from marlstream.plans import catalog

#: input -> snake, flat, digit-safe, feed, component, field, schema
GOLDEN = {
    "Hero Banner": ("hero_banner",) * 7,
    "heroBanner": ("hero_banner", "herobanner", "herobanner", "herobanner", "hero_banner", "herobanner", "hero_banner"),
    "2nd-Level": ("2nd_level", "2nd_level", "a_2nd_level", "_2nd_level", "a2nd_level", "field_2nd_level", "nd_level"),
    "$price$": ("price", "price", "$price$", "price$", "price", "price_", "price"),
    "a--b__c": ("a_b_c", "a_b_c", "a__b__c", "a__b__c", "a__b__c", "a__b__c", "a_b_c"),
    "locale": ("locale", "locale", "locale", "locale", "locale", "cm_locale", "cm_locale"),
    "pageURL": ("page_u_r_l", "pageurl", "pageurl", "pageurl", "page_url", "pageurl", "pageurl"),
}


def one(spark, *columns, **cells):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in cells.items()]) if cells else spark.range(1)
    return tuple(row.select(*columns).first())


def test_identifiers(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "k string")
    rules = (X.snake_uid, X.flat_uid, X.digit_safe_uid, X.feed_uid, X.component_uid, X.field_uid, X.schema_uid)
    found = {r[0]: tuple(r)[1:] for r in df.select("k", *[f(F.col("k")).alias(f.__name__) for f in rules]).collect()}
    assert found == GOLDEN


def test_scalars(spark):
    cases = [
        (X.compact_id(F.lit("{AB-12}")), "ab12"), (X.compact_id(F.lit("{}")), "{}"), (X.log_level(F.lit("Asset not found")), "error"), (X.log_level(F.lit("a warning")), "warn"),
        (X.encoded_uri(F.lit("http://x/a b/é?q=1&r=2#t")), "http://x/a%20b/%C3%A9?q=1&r=2#t"), (X.asset_path(F.lit(" https://h/a/b.jpg/jcr:content/x?y=1")), "/a/b.jpg"), (X.after_base(F.lit("http://x"), F.lit("http://x")), "/"),
        (X.clean_leaf(F.lit("a.b > c ")), "c"), (X.app_name(F.lit("Field (JSON Editor-App)")), "JSON Editor"), (X.human_title(F.lit("hero--banner_x")), "Hero banner x"), (X.without_block_comments(F.lit("a&lt;!-- wp:p --&gt;b")), "ab"),
        (V.leading_integer(F.lit(" -12abc")), -12), (V.leading_integer(F.lit("abc")), None), (V.number(F.lit(" ")), None), (V.number(F.lit("1e3")), 1000.0), (V.iso_date(F.lit("20220215T000000Z")), "2022-02-15T00:00:00.000Z"),
        (V.iso_date(F.lit("nonsense")), None), (V.feed_date(F.lit("0000-00-00 00:00:00")), None), (V.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))), 3), (V.upper_median(F.array().cast("array<int>")), None), (V.flag(F.lit("maybe")), True), (V.flag(F.lit(None).cast("string")), False),
        (V.moved(F.array(*map(F.lit, "abcd")), 0, 2), ["b", "c", "a", "d"]), (V.siblings(F.array(*map(F.lit, ("teaser", "teaser_1", "teasers"))), "teaser"), ["teaser", "teaser_1"]), (V.truthy(F.array(F.lit("a"), F.lit(""), F.lit(None))), ["a"]),
        (trees.prefixes(F.lit("a.b.c")), ["a", "a.b", "a.b.c"]), (trees.parent(F.lit("a")), None), (trees.leaf(F.lit("a.b")), "b"),
    ]
    found = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(found) == [wanted for _, wanted in cases]


HTML = "<h1>Hi &amp; you</h1><p>one <b>two</b><br>three</p><script>x<y</script><ul><li>a</li><li>b <a href='/u'>c</a></li></ul><img src='i.png'>"


def test_html_round_trip(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "")], "id int, html string")
    made = df.select("id", D.html_to_tree(F.col("html")).alias("tree"), D.parsed_text(F.col("html")).alias("text"))
    rows = {r.id: r for r in made.select("*", D.tree_to_html(F.col("tree")).alias("back"), D.tree_to_markdown(F.col("tree")).alias("md")).collect()}
    assert rows[1].text == "Hi & you one two three a b c" and rows[2].tree is None and rows[3].text == ""
    assert rows[1].back == '<h1>Hi &amp; you</h1><p>one <strong>two</strong>\nthree</p><ul><li>a</li><li>b <a href="/u">c</a></li></ul><img src="i.png">'
    assert rows[1].md.startswith("# Hi & you\n\none **two**\nthree\n\n- a\n- b [c](/u)")
    assert D.tree_of_html(rows[1].back) == D.tree_of_html(D.html_of_tree(D.tree_of_html(rows[1].back)))


def test_node_rows(spark):
    df = spark.createDataFrame([(1, HTML), (2, None)], "id int, html string")
    rows = D.node_rows(df, ["id"], "html").orderBy("id", "pos").collect()
    kinds = [r.type for r in rows if r.id == 1]
    assert kinds[:3] == ["doc", "h1", "text"] and kinds.count("li") == 2 and [r.href for r in rows if r.type == "a"] == ["/u"]
    assert [r.type for r in rows if r.id == 2] == ["doc"]


def test_rich_text_references(spark):
    target = lambda uid: {"target": {"sys": {"id": uid}}}
    doc = {"nodeType": "document", "content": [
        {"nodeType": "heading-2", "content": [{"nodeType": "text", "value": "T", "marks": [{"type": "bold"}]}]},
        {"nodeType": "embedded-entry-block", "data": target("e1"), "content": []}, {"nodeType": "embedded-asset-block", "data": target("gone"), "content": []},
        {"nodeType": "table", "content": [{"nodeType": "table-row", "content": [{"nodeType": "table-cell", "content": []}] * 2}]},
    ]}
    rows = spark.createDataFrame([(1, json.dumps(doc)), (2, None), (3, json.dumps(doc))], "id int, rt string")
    index = spark.createDataFrame([("entry", "e1", "page"), ("asset", "a1", "u")], "kind string, uid string, target string")
    found = {r.id: r.tree for r in D.rich_text_to_tree(rows, "rt", index).collect()}
    tree = json.loads(found[1])
    assert found[2] is None and found[3] == found[1] and len(tree["children"]) == 3
    assert tree["children"][0]["type"] == "h2" and tree["children"][1]["attrs"]["content-type"] == "page" and tree["children"][2]["attrs"] == {"cols": 2, "rows": 1}


def test_flatten_round_trip(spark):
    data = {"a": {"b": [{"c": 1}, {"c": [2, 3]}], "d": {}}, "e": [], "f": None}
    df = spark.createDataFrame([(json.dumps(data),)], "j string").select(D.json_flattened(F.col("j")).alias("flat"))
    row = df.select("flat", D.json_unflattened(F.col("flat")).alias("back")).first()
    assert json.loads(row.flat) == {"a.b[0].c": 1, "a.b[1].c[0]": 2, "a.b[1].c[1]": 3, "a.d": {}, "e": [], "f": None} and json.loads(row.back) == data


def test_mapping(spark):
    df = spark.createDataFrame([("1", "12px", "yes", "20220215T000000Z", "{AB-1}|{CD}", "r")], "id string, n string, b string, d string, refs string, pick string")
    rules = [M.Mapping("n", "number", "number"), M.Mapping("b", "flag", "boolean"), M.Mapping("d", "date", "isodate"), M.Mapping("refs", "refs", "reference"), M.Mapping("pick", "choice", "dropdown", options=(("r", "Red"),), default="None"), M.Mapping("gone", "gone", "text"), M.Mapping("id", "many", "text", multiple=True)]
    row = M.projected(df, rules, ["id"]).first()
    assert (row.number, row.flag, row.date, [x.uid for x in row.refs], row.choice, row.gone, row.many) == (12, True, "2022-02-15T00:00:00.000Z", ["ab1", "cd"], "Red", None, ["1"])
    kinds = spark.createDataFrame([("Symbol", "dropdown"), ("Symbol", "odd"), ("Odd", None)], "t string, w string")
    assert [r[0] for r in kinds.select(M.mapped_type(F.col("t"), M.SECTION_TYPES, F.col("w"))).collect()] == ["dropdown", "single_line_text", "reference"]
    schema = json.loads(one(spark, M.field_schema(F.lit("u"), F.lit("U"), F.lit("markdown"), F.lit(None).cast("boolean"), F.lit(True), F.lit("d")))[0])
    assert schema == {"data_type": "text", "display_name": "U", "uid": "u", "field_metadata": {"markdown": True, "description": "d"}, "mandatory": False, "multiple": True}


def test_mapping_by_rows(spark):
    entries = spark.createDataFrame([("p", 1), ("q", 2)], "content_type string, uid int")
    fields = spark.createDataFrame([("p", 1, "t", "x"), ("p", 1, "u", "y"), ("q", 2, "t", "z")], "content_type string, uid int, field string, value string")
    rules = spark.createDataFrame([("p", "sec.t", "title"), ("p", "v", "none")], "content_type string, source string, target string")
    found = {r.uid: r.entry for r in M.projected_by_rows(entries, ["content_type", "uid"], fields, rules).collect()}
    assert found == {1: {"title": "x"}, 2: None}


def test_numbering_over_many_tasks(spark):
    df = spark.range(1000).repartition(7)
    assert [r.n for r in windows.numbered(df, ["id"]).orderBy("id").collect()] == list(range(1, 1001))
    assert windows.numbered(df.where("id < 0"), ["id"]).collect() == []


def test_upper_medians(spark):
    rows = [(g, float(i * i % 97)) for g, n in (("a", 1), ("b", 2), ("c", 501), (None, 7)) for i in range(n)] + [("d", None), ("e", None), ("e", 2.0), ("e", 1.0), ("e", None), ("e", 3.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted((v for h, v in rows if h == g), key=lambda v: (v is None, v))
        want[g] = own[len(own) // 2]
    found = windows.upper_medians(df, "g", "v")
    assert found.columns == ["g", "median"] and sorted(found.collect(), key=str) == sorted(want.items(), key=lambda x: str(Row(g=x[0], median=x[1])))
    assert windows.upper_medians(df.where("g = 'x'"), "g", "v").collect() == []


def test_upper_median_gathers_no_group(spark, tmp_path):
    """The registered query keeps no array of a type's values, and counts nulls as its SQL twin does."""
    events = [(i, "click", float(i % 50)) for i in range(5000)] + [(i, "view", None if i % 2 else float(i)) for i in range(9)]
    spark.createDataFrame(events, "event_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    found = catalog.queries()["upper_median"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "ArraySort" not in plan
    assert dict(found.collect()) == {"click": 25.0, "view": 8.0}


def test_node_queries_agree(spark, sf_dir):
    """The flat nodes of a page hold the text that the parser gives."""
    from marlstream.plans import catalog

    found = catalog.queries()
    nodes = found["richtext_nodes"](spark, sf_dir).where("text IS NOT NULL").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))
    joined = {r.page_id: " ".join(" ".join(x.text for x in r.t).split()) for r in nodes.collect()}
    assert joined == {r.page_id: r.body for r in found["html_parsed_text"](spark, sf_dir).collect()}
    assert found["richtext_markdown"](spark, sf_dir).where("markdown != ''").count() == len(joined)


def test_feed_lookups(spark):
    from marlstream.operators import content

    items = spark.createDataFrame(
        [(1, [("X", "category", "x"), ("Y", "post_tag", "y"), ("Z", "odd", "x")], [("_thumbnail_id", "9"), ("_thumbnail_id", "7")], "Doe, Jo "), (2, [("N", "category", None)], [("k", "7")], "Nobody")],
        "id int, category array<struct<text:string,_domain:string,_nicename:string>>, `wp:postmeta` array<struct<`wp:meta_key`:string,`wp:meta_value`:string>>, creator string",
    )
    index = spark.createDataFrame([("x", "categories", "c1"), ("y", "tag", "t1"), ("x", "categories", "c0"), ("y", "terms", "no")], "slug string, content_type string, uid string")
    assert [(r.id, [x.uid for x in r.refs]) for r in content.category_references(items, "id", index).collect()] == [(1, ["c0", "t1"])]
    assets = spark.createDataFrame([("assets_7",), ("assets_8",)], "uid string")
    assert [tuple(r) for r in content.featured(items, "id", "wp:postmeta", assets).collect()] == [(1, "assets_7")]
    authors = spark.createDataFrame([("a", "Doe Jo"), ("b", "Doe Jo")], "author string, name string")
    assert sorted(r.author for r in content.by_author(items, "creator", authors, "name").collect()) == ["a", "b"]


def test_ancestors_with_a_cycle(spark):
    from marlstream.operators import content

    nodes = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None), (5, 4)], "id int, parent int")
    assert {(r.uid, r.ancestor) for r in content.ancestors(nodes, "id", "parent").collect()} == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(5, 4)}
    assert content.ancestors(nodes.where("id = 4"), "id", "parent").collect() == []


def test_ancestors_join_only_the_longest_paths(spark, monkeypatch):
    """A round joined all paths with all, so all that was below a root met in one task. Of a diamond the shortest path counts."""
    from marlstream.operators import content

    joined, join = [], type(spark.range(1)).join
    monkeypatch.setattr(type(spark.range(1)), "join", lambda a, *rest: joined.append(a.count()) or join(a, *rest))
    chain = [(i, i - 1) for i in range(1, 41)] + [(102, 101), (101, 100), (102, 100)]
    found = {(r.uid, r.ancestor): r.distance for r in content.ancestors(spark.createDataFrame(chain, "id int, parent int"), "id", "parent").collect()}
    assert found == {(i, j): i - j for i in range(1, 41) for j in range(i)} | {(102, 101): 1, (101, 100): 1, (102, 100): 1}
    # paths of 1, 2, 4, ... steps exactly
    assert joined == [43, 39, 37, 33, 25, 9]


def test_components_and_schemas(spark):
    model = {":type": "page", ":itemsOrder": ["b", "a", "gone"], ":items": {"a": {":type": "text", "t": 1}, "b": {":type": "grid", ":items": {"c": {":type": "text"}}}}, "title": "T"}
    df = spark.createDataFrame([(1, json.dumps(model)), (2, None)], "id int, m string")
    rows = D.component_rows(df, ["id"], "m").orderBy("pre").collect()
    assert [(r.path, r.type, r.depth, r.post) for r in rows] == [("", "page", 0, 3), ("/b", "grid", 1, 1), ("/b/c", "text", 2, 0), ("/a", "text", 1, 2)]
    schema = {"schema": [{"uid": "g", "display_name": "G", "data_type": "group", "schema": [{"uid": "x", "data_type": "text"}]}, {"uid": "b", "data_type": "blocks", "blocks": [{"uid": "k", "title": "K", "schema": [{"uid": "y"}]}]}]}
    flat = D.schema_rows(spark.createDataFrame([(1, json.dumps(schema))], "id int, s string"), ["id"], "s").orderBy("pos").collect()
    assert [(r.uid, r.label) for r in flat] == [("g", "G"), ("g.x", "G > x"), ("b", "b"), ("b.k", "b > K"), ("b.k.y", "b > K > y")]


def test_json_documents(spark):
    df = spark.createDataFrame([('{"b": {"id": 1, "a": [{"id": 2}]}, "index": 3}', '<p><img src="i.png"><img src="o.png"></p>'), (None, None)], "j string, h string")
    row = df.select(D.descended(F.col("j"), "id").alias("ids"), D.canonical(F.col("j")).alias("c")).first()
    assert list(row.ids) == ["1", "2"] and row.c == '{"b":{"a":[{}]}}'
    trees_ = df.select(D.html_to_tree(F.col("h")).alias("t"))
    made = D.with_assets(trees_, "t", spark.createDataFrame([("i.png", "u2"), ("i.png", "u1")], "src string, uid string"), "x").where("x IS NOT NULL").first()
    children = json.loads(made.x)["children"][0]["children"]
    assert [c["type"] for c in children] == ["reference", "img"] and children[0]["attrs"]["uid"] == "u1"
    rules = [M.Mapping("b.id", "n", "number"), M.Mapping("b.gone", "g", "text")]
    assert tuple(M.projected_json(df.where("j IS NOT NULL"), "j", rules).first()) == (1, None)


def test_small_structures(spark):
    from marlstream.operators import classify

    df = spark.createDataFrame([([("p", 1, None), (None, 2, True)], ["0", "7", None], "x/container")], "o array<struct<public_id:string,w:int,admin:boolean>>, u array<string>, path string")
    row = df.select(V.projected_objects(F.col("o"), "public_id", ["w"]).alias("a"), V.any_true(F.col("o"), "admin").alias("b"), V.references(F.col("u"), "page").alias("c"), classify.path_kind(F.col("path")).alias("d"), M.advanced(F.array(F.lit(None), F.lit("^x$")), F.lit(None).cast("boolean"), F.lit(True), F.lit("d"), F.lit("v")).alias("e")).first()
    assert [x.w for x in row.a] == [1] and row.b and [x.uid for x in row.c] == ["7"] and row.d == "container" and (row.e.validation_regex, row.e.mandatory, row.e.non_localizable) == ("^x$", False, False)


def test_file_sizes_in_the_middle_go_to_the_even_decimal(spark):
    sizes = {997 * 256: "249.2KB", 997 * 768: "747.8KB", 1024: "1.0KB", 1023: "1023bytes", 997 * 262144: "249.2MB", 1048576 * 3 // 4 * 5: "3.8MB", 1048575: "1024.0KB"}
    found = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", X.file_size(F.col("n")).alias("size"))
    assert {x.n: x["size"] for x in found.collect()} == sizes


def test_markdown_of_html_goes_through_no_text_of_trees(spark, monkeypatch):
    from marlstream.functions import documents
    from marlstream.plans import catalog

    pages = catalog.table(spark, "/root/testdata/sf0.001", "pages").select("page_id", "html").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, '<p>a<b>b</b><ol><li>x<a href="y">z</a></ol>&#xD800;')], "page_id long, html string"))
    by_tree = pages.select("page_id", documents.tree_to_markdown(documents.html_to_tree(F.col("html"))).alias("m"))
    assert sorted(map(str, documents.markdown_rows(pages, ["page_id"], "html").withColumnRenamed("markdown", "m").collect())) == sorted(map(str, by_tree.collect()))
    monkeypatch.setattr(documents, "tree_to_markdown", None)
    assert catalog.queries()["richtext_markdown"](spark, "/root/testdata/sf0.001").count() > 0


def test_node_rows_come_in_parts(spark):
    """A batch of pages gave all its nodes at once."""
    from marlstream.functions import documents

    n = documents.MOST
    rows = spark.createDataFrame([(1, "<p>x</p>" * n), (2, "<p>y</p>")], "k int, html string").coalesce(1)
    found = documents.node_rows(rows, ["k"], "html")
    sizes = [len(x) for x in found.mapInPandas(lambda parts: (x[["k"]] for x in parts), "k int").toPandas().groupby("k")["k"].apply(list)]
    assert sizes == [2 * n + 1, 3] and found.where("k = 1 AND type = 'p' AND parent = 0").count() == n
