"""Trees of JSON content against a recursion over one document at a time."""

from __future__ import annotations

import json
import random

import pytest

from marlstream.functions import json_trees
from marlstream.operators import blocks
from marlstream.session import stored


def text(x):
    return json.dumps(x, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def bare(x):
    """What a signature is made of."""
    if isinstance(x, dict):
        return {k: bare(v) for k, v in x.items() if k not in blocks.PLACES}
    return [bare(y) for y in x] if isinstance(x, list) else x


def uid(block):
    return next((str(block[u]) for u in blocks.UIDS if block.get(u)), "unknown")


def merged(group, path=""):
    """Rows of blocks (place, block) that have met under a path."""
    group = sorted(group, key=lambda x: x[0])
    seen, kept = set(), []
    for place, block in group:
        if text(bare(block)) not in seen:
            seen.add(text(bare(block)))
            kept.append((place, block))
    yield path, len(group), len(kept), group[0][0][0], text({k: v for k, v in group[0][1].items() if k not in blocks.LISTS})
    below = {}
    for place, block in kept:
        for name in blocks.LISTS:
            for i, inner in enumerate(block.get(name) if isinstance(block.get(name), list) else []):
                if isinstance(inner, dict):
                    below.setdefault(f"{path}/{name}:{uid(inner)}".lstrip("/"), []).append(((*place, i), inner))
    for p, inner in below.items():
        yield from merged(inner, p)


def block(r, depth):
    out = {"uid": r.choice(["a", "b", "c/é", ""]), "id": r.random(), "more": {"position": r.random(), "x": r.choice([1, None, "t", [1, {"id": r.random()}]])}}
    if r.random() < 0.3:
        out["fieldUid"] = r.choice(["a", "z"])
    if depth:
        for name in blocks.LISTS:
            if r.random() < 0.8:
                out[name] = [block(r, depth - 1) if r.random() < 0.9 else r.choice([None, 3, []]) for _ in range(r.randint(0, 3))]
    elif r.random() < 0.3:
        out["blocks"] = "none"
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_merged_by_signature(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice(["m", "", None]), i, text(block(r, 3))) for i in range(14)]
    rows += [("m", 20 + i, t) for i, (_, _, t) in enumerate(rows[:3])] + [("m", 40, "no json {"), ("m", 41, None), ("other", 42, "{}")]
    docs = spark.createDataFrame(rows, "model string, no long, content string")
    found = blocks.merged_by_signature(docs, "model", "no", "content")
    wanted = []
    for model in ("m", "", None, "other"):
        group = [((no,), json.loads(t)) for m, no, t in rows if m == model and t and t.startswith("{")]
        if group:
            wanted += [(model, *x) for x in merged(group)]
    assert sorted(((x.model, x.path, x.n, x.kept, x.first, text(json.loads(x.attributes))) for x in found.collect()), key=repr) == sorted(wanted, key=repr)


@pytest.fixture
def not_coalesced(spark):
    """Several tasks, however small the tables."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("held", [json_trees.HELD, 3000, 0])
def test_models_are_merged_in_their_task_by_levels_or_cut_by_ranges(spark, monkeypatch, not_coalesced, held):
    monkeypatch.setattr(json_trees, "HELD", held)
    r = random.Random(held)
    rows = [(m, i, text(block(r, 2))) for i, m in enumerate(sorted(r.choices(["a", "b", "c", "d", "e", "f", "g", "h", "large"], [1] * 8 + [8], k=90)))]
    rows += [(m, 100 + i, t) for i, (m, _, t) in enumerate(r.sample(rows, 20))]
    found = blocks.merged_by_signature(spark.createDataFrame(r.sample(rows, len(rows)), "model string, no int, content string"), "model", "no", "content")
    wanted = [(model, *x) for model in {m for m, _, _ in rows} for x in merged([((no,), json.loads(t)) for m, no, t in rows if m == model])]
    assert sorted((x.model, x.path, x.n, x.kept, x.first, text(json.loads(x.attributes))) for x in found.collect()) == sorted(wanted)


@pytest.mark.parametrize("kind", ["timestamp", "string", "decimal(20,3)", "date"])
def test_identifiers_and_attributes_are_the_same_in_a_task_and_by_levels(spark, monkeypatch, kind):
    uids = ["1", "1e3", "1.50", "-0", "1e12", "true", '"true"', '"1"', '"a/blocks:b"', '"\\u00e9\\""', '""', "null", "[]", "{}", "0.0000001"]
    inner = ",".join(f'{{"uid":{u},"id":{i},"x":[1e3,{{"index":1}}]}}' for i, u in enumerate(uids))
    outer = ",".join(f'{{"schema":[{inner}],"uid":{u}}}' for u in [*uids, '"a"', '"a"'])
    texts = [f'{{"blocks":[{outer},[{{"blocks":[{{}}]}}]],"more":{{"blocks":[{{}}]}}}}', f'{{"blocks":[{inner}],"schema":[{inner}]}}', f"[{outer}]", "7", '{"blocks":{}}']
    docs = spark.createDataFrame([(m, f"2020-01-0{i + 1}" if i else None, t) for m in range(4) for i, t in enumerate(texts[m % 2 :])], "model int, no string, content string")
    made = {"decimal(20,3)": "replace(no, '-', '')"}.get(kind, "no")
    docs = docs.selectExpr("model", f"cast({made} AS {kind}) AS no", "content")
    found = []
    for held in (json_trees.HELD, 0):
        monkeypatch.setattr(json_trees, "HELD", held)
        frame = blocks.merged_by_signature(docs, "model", "no", "content")
        assert frame.schema["first"].dataType == docs.schema["no"].dataType
        found.append(sorted(map(tuple, frame.collect()), key=repr))
    assert len(found[0]) > 100 and found[0] == found[1] and {m for m, path, _, _, first, _ in found[0] if path == "" and first is None} == {0, 1, 2, 3}


def test_blocks_of_models_that_a_task_has_whole_are_not_written(spark, monkeypatch):
    content = text({"uid": "r", "blocks": [{"uid": f"u{i % 3}", "id": i} for i in range(50)]})
    docs = spark.createDataFrame([(m, i, content) for m in range(40) for i in range(5)], "model int, no int, content string")
    written = []
    monkeypatch.setattr(blocks, "stored", lambda df: (written.append((found := stored(df)).count()), found)[1])
    found = blocks.merged_by_signature(docs, "model", "no", "content").collect()
    assert {(x.path, x.n, x.kept) for x in found} == {("", 5, 1), ("blocks:u0", 17, 1), ("blocks:u1", 17, 1), ("blocks:u2", 16, 1)} and len(found) == 40 * 4
    # all 40 models have 10,200 blocks, the two at the ends of the one task 510
    assert sum(written) < 2000


def test_signatures_of_order_and_place(spark):
    same = ['{"uid":"a","id":1,"l":[1,2]}', '{"l":[1,2],"id":2,"index":9,"uid":"a"}']
    other = ['{"uid":"a","l":[2,1]}', '{"uid":"a","l":["1",2]}', '{"uid":"a","l":[1,2],"m":null}', '{"uid":"a","l":[[1,2]]}', '{"uid":"a","l":{"0":1,"1":2}}']
    docs = spark.createDataFrame(list(enumerate(same + other)), "k int, t string")
    tree = blocks.nodes(docs, ["k"], "t")
    roots = lambda ordered: {x.k: (x.sig1, x.sig2) for x in blocks.signatures(tree, ["k"], ordered=ordered).where("depth = 0").collect()}
    found, free = roots(True), roots(False)
    assert found[0] == found[1] and len(set(found.values())) == 1 + len(other)
    assert free[0] == free[1] == free[2] and len(set(free.values())) == len(other)
    assert blocks.signatures(blocks.nodes(docs.where("k > 99"), ["k"], "t"), ["k"]).collect() == []


def fold(target, source, path=""):
    """source merged into target."""
    out = dict(target)
    for k, new in source.items():
        own, here = out.get(k), f"{path}.{k}".lstrip(".")
        if new is None:
            continue
        if isinstance(new, dict):
            out[k] = fold(own if isinstance(own, dict) else {}, new, here)
        elif isinstance(new, list):
            own = own if isinstance(own, list) else []
            for x in new:
                if here == "blocks" or text(x) not in map(text, own):
                    own = [*own, x]
            out[k] = own
        elif own is None:
            out[k] = new
    return out


def leaves(x, path=""):
    if isinstance(x, dict):
        for k, v in x.items():
            yield from leaves(v, f"{path}.{k}".lstrip("."))
    elif isinstance(x, list):
        yield from ((f"{path}[{i}]", text(v)) for i, v in enumerate(x))
    elif x is not None:
        yield path, str(x)


def settings(r, depth=2):
    some = lambda: r.choice([None, "s", 3, [r.randint(0, 2), {"q": r.randint(0, 1), "p": None}, None][: r.randint(0, 3)], settings(r, depth - 1) if depth else {}])
    return {k: some() for k in r.sample(["a", "b", "c", "blocks"], r.randint(0, 4))}


@pytest.mark.parametrize("seed", [1, 2])
def test_deep_merged(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([1, 2, None]), i, text(settings(r))) for i in range(40)] + [(3, 90, None), (3, 91, "[1]"), (3, 92, "nothing")]
    rows = [x for x in rows if x[2] != "[1]"]
    found = blocks.deep_merged(spark.createDataFrame(rows, "g int, no long, s string"), "g", "no", "s")
    wanted = []
    for g in (1, 2, None):
        total = {}
        for _, _, t in sorted((x for x in rows if x[0] == g), key=lambda x: x[1]):
            total = fold(total, json.loads(t))
        wanted += [(g, *x) for x in leaves(total)]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(wanted, key=repr)


def test_a_long_union_is_ranked(spark):
    rows = [(1, i, text({"l": [i % 700, (i * 7) % 1000]})) for i in range(3000)]
    found = blocks.deep_merged(spark.createDataFrame(rows, "g int, no int, s string").repartition(6), "g", "no", "s").collect()
    order = list(dict.fromkeys(x for _, _, t in rows for x in json.loads(t)["l"]))
    assert {x.path: int(x.value) for x in found} == {f"l[{i}]": v for i, v in enumerate(order)}
    assert blocks.deep_merged(spark.createDataFrame([], "g int, no int, s string"), "g", "no", "s").collect() == []


def test_rematched_types_are_settled_without_a_sort_of_all(spark, monkeypatch):
    """By ranges and within types the same, for equal keys, null keys and types, and types of both sizes at once."""
    from marlstream.operators import rematch

    own = [(t, f"f{i:02}", None if i % 7 == 0 else f"u{i % 3}", None if i % 5 == 0 else f"p{i % 4}") for t, n in ((1, 40), (2, 9), (3, 1), (None, 2)) for i in range(n)]
    other = [(t, i, None if i % 6 == 0 else f"u{i % 4}", None if i % 11 == 0 else f"p{i % 5}", f"k{i}") for t, n in ((1, 30), (2, 12), (4, 2), (None, 3)) for i in range(n)]
    mapped = spark.createDataFrame(own, "type int, field string, uid string, path string")
    changed = spark.createDataFrame(other, "type int, place int, uid string, path string, field_type string")
    found = {most: sorted(map(str, rematch.rematched(mapped, changed, most=most).collect())) for most in (0, 30, 1000)}
    assert found[0] == found[30] == found[1000] and len(found[0]) == len(own)
    monkeypatch.setattr(rematch, "numbered", None)
    assert sorted(map(str, rematch.rematched(mapped, changed).collect())) == found[0]
