"""One JSON document in many byte ranges, against a parse of the whole."""

from __future__ import annotations

import json
import random

import pytest

from marlstream.sources import large_json


@pytest.fixture
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    yield lambda n: [spark.conf.set(x, str(n)) for x in names]
    for n, value in before.items():
        spark.conf.set(n, value)


def hard(r, depth=2):
    """Values with brackets, quotes and backslashes in their texts and names."""
    text = lambda: "".join(r.choice(["}", "{", "]", "[", '"', "\\", ",", ":", "é", "日", "a", '\\"', "\n"]) for _ in range(r.randint(0, 12)))
    kind = r.randrange(6 if depth else 3)
    if kind < 2:
        return text()
    if kind == 2:
        return r.choice([1, 2.5, None, True])
    if kind == 3:
        return [hard(r, depth - 1) for _ in range(r.randint(0, 3))]
    return {text(): hard(r, depth - 1) for _ in range(r.randint(0, 3))}


@pytest.mark.parametrize(("seed", "size", "indent"), [(1, 230, None), (2, 411, 1), (5, 197, None)])
def test_equal_to_the_whole_parse(spark, tmp_path, small_ranges, seed, size, indent):
    r = random.Random(seed)
    doc = {"version": "1}0\\", "contentTypes": [hard(r) for _ in range(60)], "none": [], "settings": {"a": [1, {"b": "}"}]}, "n": 3, "empty": {}, "entries": [{"k": i, "v": hard(r)} for i in range(80)], "last": "x{", "flag": None}
    (tmp_path / "d.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=bool(seed % 2)) + "\n" * (seed % 2), encoding="utf-8")
    small_ranges(size)
    pieces = large_json._pieces(spark, str(tmp_path / "d.json"))
    assert pieces.select("start").distinct().count() > 5
    found = {}
    for x in large_json.elements(spark, str(tmp_path / "d.json")).collect():
        found.setdefault(x.section, []).append((x.pos, json.loads(x.json)))
    wanted = {k: list(enumerate(v)) if isinstance(v, list) else [(0, v)] for k, v in doc.items() if v != []}
    assert {k: sorted(v, key=lambda y: y[0]) for k, v in found.items()} == wanted


def test_an_element_longer_than_many_ranges(spark, tmp_path, small_ranges):
    doc = {"a": [{"t": "}" * 5000, "u": [{"x": i} for i in range(500)]}, 1, "}"], "b": [[]]}
    (tmp_path / "d.json").write_text(json.dumps(doc))
    small_ranges(1500)
    found = {(x.section, x.pos): json.loads(x.json) for x in large_json.elements(spark, str(tmp_path / "d.json")).collect()}
    assert found == {("a", 0): doc["a"][0], ("a", 1): 1, ("a", 2): "}", ("b", 0): []}


def test_schemas_several_files_and_none(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text(json.dumps({"entries": [{"id": f"{k}{i}", "n": i, "more": {}} for i in range(3)]}))
    found = large_json.sections(spark, str(tmp_path), {"entries": "id string, n int", "assets": "id string"})
    assert sorted(map(tuple, found["entries"].collect())) == [(i, f"{k}{i}", i) for i in range(3) for k in range(2)]
    assert found["assets"].collect() == [] and found["assets"].columns == ["pos", "id"]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.json").write_text("")
    assert large_json.elements(spark, str(tmp_path / "empty")).collect() == []


def test_structure_is_found_once_for_both_cases(monkeypatch):
    """Whether a range starts in a string isn't known when brackets are counted; each piece was scanned three times for that."""
    import pyarrow as pa

    text = r'{"a":[{"x":"\\\"}],{\\"},' + '"' + "\\" * 101 + '"' + r'"],"b":{"c":"' + "\\" * 80 + '"}}'
    scans, scan = [], large_json._structure
    monkeypatch.setattr(large_json, "_structure", lambda *a: scans.append(len(a[0])) or scan(*a))
    pieces = text.split("}")
    batches = [pa.RecordBatch.from_pydict({"file": [7] * len(x), "start": [0] * len(x), "value": x}) for x in (pieces[:2], pieces[2:])]
    row = next(iter(large_json._sums(batches))).to_pylist()[0]

    def plain(inside):
        depth, escaped = 0, False
        for c in text + "}":
            if c == '"' and not escaped:
                inside = not inside
            elif not inside:
                depth += (c in "{[") - (c in "}]")
            escaped = c == "\\" and not escaped
        return depth

    assert (row["outside"], row["inside"]) == (plain(False), plain(True)) and len(scans) == 2
