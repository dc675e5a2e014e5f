from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from marlstream.functions import json_trees
from marlstream.operators import blocks, nested

ODD = [
    '{"a":"q\\"\\\\u001f\\u001f\\n\\u00e9\\ud83d\\ude00/","b":[1.50,1e3,-0,-0e0,1e12,12345678901234567890,1e400,0.0000001],"c":{"d.e":null,"":[[],{}]}}',
    '[[1,[true,false]],"",{"x":{}}]', '"bare"', "null", "7.0", "{broken", '{"a":1,"a":2}', None,
]


def jobs(spark, run):
    """What run gives and how many jobs it took."""
    sc = spark.sparkContext
    sc.setJobGroup(run.__name__, "")
    try:
        return run(), len(sc.statusTracker().getJobIdsForGroup(run.__name__))
    finally:
        sc._jsc.clearJobGroup()


def deep(levels):
    return '{"k":' * levels + '[{"uid":"u","v":1}]' + "}" * levels


def test_documents_are_opened_in_one_go(spark):
    docs = spark.createDataFrame([(1, deep(40))], "k int, t string")

    def opening():
        return blocks.nodes(docs, ["k"], "t").count(), nested.leaves(docs, "k", "t").orderBy("path").collect()

    (count, found), taken = jobs(spark, opening)
    assert count == 40 + 4 and [(x.path, x.value) for x in found] == [(".".join(["k"] * 40) + "[0].uid", "u"), (".".join(["k"] * 40) + "[0].v", "1")]
    assert taken < 12


def test_signatures_and_merges_read_a_document_once(spark):
    rows = [(1, 1, '{"uid":"r","blocks":[{"uid":"a","id":1,"x":[1,2]}]}'), (1, 2, '{"blocks":[{"x":[1,2],"uid":"a","id":2}],"uid":"r"}'), (1, 3, '{"uid":"r","blocks":[{"uid":"a","x":[2,1]}]}')]
    docs = spark.createDataFrame([(g, n, t[:-1] + ',"deep":' + deep(30) + "}") for g, n, t in rows], "g int, n int, t string")

    def signing():
        return {x.n: (bytes(x.a), bytes(x.b)) for x in blocks.document_signatures(docs, ["n"], "t", orders={"a": True, "b": False}).collect()}

    found, taken = jobs(spark, signing)
    assert taken < 4 and found[1] == found[2] and found[1][0] != found[3][0] and found[1][1] == found[3][1]

    def merging():
        return {x.path: (x.n, x.kept, x.first) for x in blocks.merged_by_signature(docs, "g", "n", "t").collect()}

    found, taken = jobs(spark, merging)
    assert found == {"": (3, 2, 1), "blocks:a": (2, 2, 1)} and taken < 20


@pytest.mark.parametrize("document", ODD)
def test_texts_are_those_of_spark(spark, document):
    docs = spark.createDataFrame([(1, document)], "k int, t string")
    found = blocks.nodes(docs, ["k"], "t").withColumn("again", F.to_json(F.parse_json("json"))).collect()
    whole = docs.select(F.to_json(F.parse_json(F.to_json(F.try_parse_json("t")))).alias("j")).first().j
    assert [x.json for x in found if x.depth == 0] == ([] if whole is None else [whole])
    assert all(x.json == x.again for x in found)
    values = {x.path: x.json for x in found if x.kind == "value"}
    spark_values = {p: spark.createDataFrame([(j,)], "j string").select(F.try_variant_get(F.parse_json("j"), "$", "string").alias("v")).first().v for p, j in values.items()}
    assert {x.path: x.value for x in nested.leaves(docs, "k", "t").collect()} == spark_values


def test_large_documents_come_in_several_batches(spark):
    docs = spark.createDataFrame([(1, json.dumps(list(range(json_trees.MOST + 5)))), (2, "[1]")], "k int, t string").coalesce(1)
    assert {x.k: x["count"] for x in nested.leaves(docs, "k", "t").groupBy("k").count().collect()} == {1: json_trees.MOST + 5, 2: 1}


def test_documents_of_one_file_are_dealt_out_before_they_are_opened(spark):
    docs = spark.createDataFrame([(1, "[1]")], "k int, t string").coalesce(1)
    assert "REPARTITION_BY_COL" in nested.leaves(docs, "k", "t")._jdf.queryExecution().toString()


def test_projected_documents_do_not_shuffle_leaves(spark):
    """The same as by join and grouping, for documents that share a key, odd keys and numbers, paths that meet, and no JSON."""
    docs = [
        (1, '{"a":[{"b":[1,2.50,1e3],"c":"x\\n\\"y"},{"b":[-0.0,12345678901234567890123,1e40],"c":true}],"d":{"e":null,"f":"z"}}'),
        (1, '{"a":[{"b":[0]}],"d":{"f":"a"}}'), (2, '{"a[3]":{"b":[7]},"x.y":"dotted","x":{"y":"nested"}}'), (3, "no JSON"), (None, '{"d":{"f":"null"}}'), (None, '{"d":{"f":"key"}}'), (4, '{"a[":[{"q":1}]}'),
    ]
    frame = spark.createDataFrame(docs, "k int, j string")
    mapping = spark.createDataFrame([("a[].b[]", "n[].m[]"), ("a[].b[]", "flat[]"), ("a[].b[]", "one"), ("a[].c", "n[].deep[].t[]"), ("d.f", "one"), ("x.y", "two"), ("a[[].q", "odd[]"), ("d.f", "one"), (None, "never")], "source string, target string")
    joined = nested.projected_documents(frame, "k", "j", mapping, most=1)
    opened = nested.projected_documents(frame, "k", "j", mapping)
    assert sorted(map(str, opened.collect())) == sorted(map(str, joined.collect()))
    assert opened.where("k = 1").count() == 11
    plan = opened._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


def test_plain_leaves_are_as_spark_reads_them(spark):
    each = ["1", "-0", "-0.0", "1.0", "1.50", "0.10", "1e3", "1E-7", "1.5e300", "123456789012345678901234567890", "9" * 40, "1.00000000000000000000000000000000000000000001", "true", "false", '"a\\u0001\\/\\\\b\\u00e9"', '""', "12345.678900", "100", "1e2", "0e0"]
    docs = spark.createDataFrame([(i, '{"v":' + x + "}") for i, x in enumerate(each)], "k int, j string")
    raw = json_trees.rows(docs, ["k"], "j", json_trees.leaves, "path string, value string").withColumn("value", json_trees.plain(F.col("value")))
    assert sorted(map(tuple, nested.leaves(docs, "k", "j").collect())) == sorted(map(tuple, raw.collect()))
