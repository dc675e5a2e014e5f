from __future__ import annotations

import json
import math
import random
import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from marlstream.llm import tool_chat, url_rules

URLS = [
    "https://a.net/x/1", "https://a.net/x/2?k=1", "http://www.Example.NET/en/a", "http://example.net/de/", "ftp://m.example.com/de/q#t", "http://example.com/fr/", "https://b.org/fr/", "https://b.org/en/", "no url", None, "", "http://", "https://spam.biz/win/7",
    "https://spam.biz/win/9?x=2", "https://ok.biz/news", "https://net/", "https://xnet/", "http://h.example.net/en", "x://y?z", "https://spam.biz", "https://u.io/a\nb/c",
]


def rule_of(url):
    if url is None or "://" not in url:
        return "", "", None
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
    host, path = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]
    fits = [(len(h + p), h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def pages_and_labels(spark):
    pages = spark.createDataFrame(list(enumerate(URLS * 3)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("set_id", F.lit(1))
    flags = [(i, 1 if "spam" not in (u or "") else 0, 0) for i, u in enumerate(URLS * 3) if i % 4 != 3] + [(1, None, None), (2, 1, 0), (None, 0, 1)]
    return pages, spark.createDataFrame(flags, "doc_id long, quality int, toxic int")


def brute_rules(taught):
    """The rules that stay, from (token set, blocked) of each labelled URL."""
    sets = {frozenset(c) for t, _ in taught for n in range(1, len(t) + 1) for c in combinations(sorted(t), n)}
    rules = {}
    for s in sets:
        n_all, n_block = sum(s <= t for t, _ in taught), sum(s <= t and b for t, b in taught)
        if n_block and n_block >= url_rules.MIN_SUPPORT * len(taught) and n_block / n_all >= url_rules.MIN_CONFIDENCE:
            rules[s] = n_block / n_all
    return [s for s, c in rules.items() if not any(t < s and d >= c for t, d in rules.items())]


def check_against_brute_force(pages, labels, urls):
    found = {x.page_id: x for x in url_rules.judge(pages, labels).collect()}
    tokens = {x.page_id: frozenset(x.t) for x in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    flags = {}
    for x in labels.collect():
        if x.quality is not None or x.toxic is not None:
            flags[x.doc_id] = flags.get(x.doc_id, False) or x.toxic == 1 or x.quality == 0
    rules = brute_rules([(tokens[i], b) for i, b in flags.items() if i in tokens and tokens[i]])
    assert rules
    for i, url in enumerate(urls):
        host, path, listed = rule_of(url)
        n = sum(s <= tokens[i] for s in rules)
        want = (host, path, listed[0], listed[1]) if listed else (host, path, None, "block" if n else "allow")
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict, found[i].n_fired) == (*want, n), url


@pytest.mark.parametrize("fp_classes", [12, 0])
def test_url_rules_against_brute_force(spark, monkeypatch, fp_classes):
    monkeypatch.setattr(url_rules, "FP_CLASSES", fp_classes)
    check_against_brute_force(*pages_and_labels(spark), URLS * 3)


@pytest.mark.parametrize("fp_classes", [12, 0])
def test_url_rules_of_several_tokens(spark, monkeypatch, fp_classes):
    """Combinations that are blocked though their parts aren't."""
    monkeypatch.setattr(url_rules, "FP_CLASSES", fp_classes)
    r = random.Random(3)
    urls = ["https://h{}.io/{}".format(r.randrange(2), "/".join(sorted(r.sample("abcdef", r.randrange(1, 5))))) for _ in range(60)]
    blocked = [("/a/" in u + "/" and "/c/" in u + "/") or ("h1" in u and u.endswith("e")) or r.random() < 0.1 for u in urls]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if b else 1, 0) for i, b in enumerate(blocked)], "doc_id long, quality int, toxic int")
    check_against_brute_force(pages, labels, urls)


def test_url_rules_long_urls(spark):
    """Forty segments, alone and as prefixes of one another, and one URL of some 100,000 characters."""
    segments = [chr(97 + i // 20) + chr(97 + i % 20) for i in range(40)]
    urls = ["https://long.io/" + "/".join(segments[:n]) for n in (40, 40, 30, 20)] + ["https://long.io/" + "/".join(f"{'xyz'[i % 3]}q{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for i in range(14000)), "https://fine.io/aa"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    found = {x.page_id: x for x in url_rules.judge(pages, labels).collect()}
    assert all(found[i].verdict == "block" for i in (0, 1, 2, 4))
    tokens = {x.page_id: frozenset(x.t) for x in pages.select("page_id", url_rules.tokens_of(F.col("url")).alias("t")).collect()}
    assert len(tokens[4]) > 10_000
    flags = {0: 1, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0}
    # rules of one token by brute force; those of more can only be better than the best inside them
    share = lambda s: sum(flags[i] for i in flags if s <= tokens[i]) / sum(s <= tokens[i] for i in flags)
    single = {t: share({t}) for t in set().union(*tokens.values())}
    classes = {}
    for t in sorted(single):
        classes.setdefault(tuple(i for i in flags if t in tokens[i]), []).append(t)
    firsts = {c[0]: len(c) for c in classes.values()}
    rules = brute_rules([(tokens[i] & firsts.keys(), bool(b)) for i, b in flags.items()])
    for i in flags:
        want = sum(math.prod(firsts[t] for t in s) for s in rules if s <= tokens[i])
        assert found[i].n_fired == want


def test_url_rules_empty(spark):
    pages, labels = pages_and_labels(spark)
    assert url_rules.judge(pages.where("page_id < 0"), labels).collect() == []
    assert {x.verdict for x in url_rules.judge(pages.where("page_id = 12"), labels.where("doc_id < 0")).collect()} == {"allow"}


def test_tool_chat(spark):
    good = '{"words":2,"question":"q"}'
    calls = [(1, 0, "a", "ask", good, None), (1, 1, "b", "ask", '{"question":"","words":0,"more":1}', "a"), (1, 2, "c", "ask", "{broken", "gone"), (1, 3, "d", "other", good, "b"),
             (2, 0, "x", "ask", good, "y"), (2, 1, "y", "ask", good, "x"), (2, 2, "z", "ask", good, "y"), (3, 0, None, "ask", good, None), (3, 1, "a", "ask", good, None), (4, 0, "n", "ask", '{"words":"two"}', None), (4, 1, "e", "ask", None, None)]
    results = [(1, 5, "a", "first"), (1, 6, "a", "again"), (9, 0, "orphan", "r"), (1, 7, "d", None), (5, 0, None, "lost")]
    found = {}
    frame = tool_chat.link(spark.createDataFrame(calls, "conv_id long, turn long, call_id string, tool string, payload string, after string"), spark.createDataFrame(results, "conv_id long, turn long, call_id string, payload string"))
    for x in frame.collect():
        found.setdefault(x.call_id, []).append(x)
    status = {k: v[0].status for k, v in found.items() if k}
    assert status == {"a": "ok", "b": "invalid_arguments", "c": "invalid_arguments", "d": "invalid_arguments", "x": "cycle", "y": "cycle", "z": "cycle", "n": "invalid_arguments", "e": "invalid_arguments", "orphan": "orphan_result"}
    assert found["a"][0].n_repeats == 2 and found["a"][0].depth == 0 and found["d"][0].depth == 2 and found["c"][0].depth == 0
    assert found["b"][0].errors == ["question: too short", "words: too small", "more: unexpected"] and found["d"][0].errors == ["unknown_tool"] and found["n"][0].errors == ["question: missing", "words: not integer"]
    assert found["a"][0].json == '{"arguments":{"question":"q","words":2},"call_id":"a","result":"first","tool":"ask"}' and len(found[None]) == 2
    assert json.loads(found["c"][0].json)["arguments"] is None


BOOK = {
    "when": {"type": "object", "required": True, "properties": {"day": {"type": "string", "required": True, "pattern": "^[0-9]{4}-[0-9]{2}$"}, "hour": {"type": "integer", "minimum": 0, "maximum": 23}}},
    "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}},
    "size": {"type": "string", "enum": ["s", "m"]},
}


def test_nested_schemas(spark):
    rows = [
        ('{"when":{"day":"2024-01","hour":5},"tags":["a","b"],"size":"m"}', []),
        ('{"when":{"day":"2024","hour":24,"more":1}}', ["when.day: doesn't match", "when.hour: too large", "when.more: unexpected"]),
        ('{"when":[],"tags":["a",1],"size":"l"}', ["size: not a choice", "tags: an element is not string", "tags: an element is not a choice", "when: not object"]),
        ('{"when":{},"tags":"a","size":null,"other":{}}', ["tags: not array", "when.day: missing", "other: unexpected"]),
        ("{}", ["when: missing"]),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i long, t string").select("i", tool_chat.argument_errors(F.try_parse_json("t"), BOOK).alias("e"))
    assert [x.e for x in frame.orderBy("i").collect()] == [want for _, want in rows]


def test_canonical_numbers_and_clashing_columns(spark):
    """Numbers are written as VARIANT holds them: decimals without trailing zeros, those with an exponent as doubles."""
    calls = spark.createDataFrame([(1, i, f"c{i}", "ask", f'{{"words":{x},"question":"q"}}', None) for i, x in enumerate(["1.0", "1e3", "-0", "12345678901234567890", "0.10"])], "conv_id long, turn long, call_id string, tool string, payload string, after string")
    calls = calls.withColumn("depth", F.lit("clash")).withColumn("status", F.lit("clash")).withColumn("errors", F.lit("clash"))
    results = spark.createDataFrame([(1, 1, "c0", "r" * 2_000_000)], "conv_id long, turn long, call_id string, payload string").withColumn("json", F.lit("clash"))
    found = {x.call_id: x for x in tool_chat.link(calls, results).collect()}
    assert {k: re.search(r'"words":([^}]*)', v.json)[1] for k, v in found.items()} == {"c0": "1", "c1": "1000.0", "c2": "0", "c3": "12345678901234567890", "c4": "0.1"}
    assert len(found["c0"].json) > 2_000_000 and found["c0"].depth == 0


def test_tool_chat_long_chain_and_empty(spark):
    links = spark.range(300).select(F.col("id").cast("string").alias("call_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("after"))
    assert {(int(x.call_id), x.depth) for x in tool_chat.depths(links).collect()} == {(i, i) for i in range(300)}
    none = spark.createDataFrame([], "conv_id long, turn long, call_id string, tool string, payload string, after string")
    assert tool_chat.link(none, none.select("conv_id", "turn", "call_id", "payload")).collect() == []
