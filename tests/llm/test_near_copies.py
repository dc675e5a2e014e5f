from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from marlstream.llm import components, near_copies


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return sorted(((i, len(shingles(t)), None if i is None else find(i), i is None or find(i) == i) for i, t in rows), key=repr)


def corpus(seed, groups=12):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 40, 120]))]
        for _ in range(r.randint(1, 25)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", None, "  \t", rows[0].upper(), rows[0] + "\n", "one", "ONE", "één"]
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "small"), [(1, 16), (2, 2), (3, 4)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(near_copies, "SMALL", small)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rep", F.lit(1)).repartition(4)
    assert sorted((tuple(x) for x in near_copies.groups(docs).collect()), key=repr) == brute(rows)


def test_odd_ids_and_empty(spark):
    same = "a b c d e f g"
    docs = spark.createDataFrame([(None, same), (5, same), (5, same), (2, same)], "doc_id long, text string")
    found = sorted((x.doc_id or -1, x.component_id, x.kept) for x in near_copies.groups(docs).collect())
    assert found == [(-1, None, True), (2, 2, True), (5, 2, False), (5, 2, False)]
    assert near_copies.groups(docs.where("doc_id = 77")).collect() == []
    kept = near_copies.keep_one_of_each(spark, docs.withColumn("lang", F.lit("en")), "")
    assert sorted(x.doc_id or -1 for x in kept.collect()) == [-1, 2] and kept.columns == ["doc_id", "text", "lang"]


def test_one_id_with_several_texts(spark):
    """All rows of an id are one document, with the links of each of its texts."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(5, a), (5, b), (3, b), (7, a), (8, a + " z"), (9, "c d e"), (9, "f g h"), (10, "f g h"), (11, "i j k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sorted((x.doc_id, x.component_id, x.kept) for x in near_copies.groups(docs).collect())
    assert found == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (8, 3, False), (9, 9, True), (9, 9, True), (10, 9, False), (11, 11, True)]
    kept = sorted((x.doc_id, x.text) for x in near_copies.keep_one_of_each(spark, docs, "").collect())
    assert [i for i, _ in kept] == [3, 9, 11] and kept[1][1] in ("c d e", "f g h")


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {x.component for x in components.components(edges).collect()} == {0}
