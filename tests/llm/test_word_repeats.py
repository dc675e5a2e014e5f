from __future__ import annotations

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from marlstream.llm import word_repeats


def brute(rows, width):
    docs = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    first = {}
    for i, w in docs:
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = []
    for i, w in docs:
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (i, p):
                gone |= set(range(p, p + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("seed", "width"), [(1, 20), (2, 6), (3, 3)])
def test_against_brute_force(spark, seed, width):
    r = random.Random(seed)
    words = ["a", "b", "c", "d", "é", "Ω x", "word"]
    text = lambda n: r.choice([" ", "\n", "  \t"]).join(r.choice(words) for _ in range(n))
    shared = [text(r.randint(width, 3 * width)) for _ in range(4)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join([text(r.randint(0, 30)), r.choice(["", *shared]), text(r.randint(0, 30)), r.choice(["", *shared])])))
    for i in range(60, 80):
        w = r.choice(rows)[1].split(" ")
        w[r.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w)))
    rows += [(80, None), (81, ""), (82, "a " * 200), (83, "a b " * 100), (84, " ".join(["x"] * width)), (85, " ".join(["x"] * width))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash")).repartition(5)
    found = word_repeats.dedup(docs, width=width, with_text=False)
    assert sorted(tuple(x) for x in found.collect()) == brute(rows, width)


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(2, same), (None, same), (3, "x " + same), (3, "x " + same)], "doc_id long, text string")
    found = sorted((x.doc_id or -1, x.n_removed, x.kept) for x in word_repeats.dedup(docs).collect())
    assert found == [(-1, 0, same), (2, 25, ""), (3, 25, "x"), (3, 25, "x")]
    assert word_repeats.dedup(docs.where("doc_id > 9")).collect() == []


def test_several_texts_of_one_id(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (1, b), (1, a), (2, a), (None, b)], "doc_id long, text string").repartition(3)
    found = sorted((x.doc_id or 0, x.n_removed, x.kept) for x in word_repeats.dedup(docs).collect())
    assert found == [(0, 0, b), (1, 0, a), (1, 0, a), (1, 60, ""), (2, 60, "")]


def test_a_hundred_thousand_equal_rows(spark):
    """Equal rows are one document, so their number costs no more than to read and to answer them."""
    same = " ".join(f"w{i}" for i in range(300))
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(same).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(5, "x " + same), (5, "x " + same)], "doc_id long, text string"))
    found = word_repeats.dedup(docs, with_text=False).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(tuple, found), key=repr) == [(5, 301, 300, 2), (None, 300, 0, 100_000)]
