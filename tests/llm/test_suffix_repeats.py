from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstream.llm import suffix_repeats


def brute(rows, width):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(t[p : p + width] for _, t in data for p in range(len(t) - width + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = b"\x01" * width
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, width):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé \n") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(r.randint(5, 40)) for _ in range(4)]
    texts = [text(r.randint(0, 60)) + r.choice(["", *shared]) + text(r.randint(0, 40)) + r.choice(["", *shared]) for _ in range(60)]
    for _ in range(25):
        t = list(r.choice(texts))
        for _ in range(r.randint(0, 3)):
            if t:
                t[r.randrange(len(t))] = r.choice(["x", "", "yy"])
        texts.append("".join(t))
    texts += ["a" * 500, "ab" * 300, "a" * (width + 1), "a" * width, "q" * (width - 1), "", None, "x" * width, "zab" * 100 + shared[0]]
    rows = list(enumerate(texts))
    return rows + [(None, texts[0]), (3, shared[0] * 3), (3, texts[3])]


@pytest.mark.parametrize(("seed", "width"), [(1, 40), (2, 100), (3, 24)])
def test_against_brute_force(spark, seed, width):
    rows = corpus(seed, width)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("places", F.lit("clash")).repartition(5)
    found = suffix_repeats.dedup(docs, width=width, with_text=False)
    assert sorted((tuple(x) for x in found.collect()), key=repr) == brute(rows, width)


def test_spans_and_bytes(spark):
    same = "".join(chr(97 + i % 26) + str(i) for i in range(40))
    docs = spark.createDataFrame([(1, "left " + same), (2, same + " right"), (3, None)], "doc_id long, text string")
    found = {x.doc_id: x for x in suffix_repeats.dedup(docs, width=30).collect()}
    assert bytes(found[1].kept) == b"left " and bytes(found[2].kept) == b" right" and bytes(found[3].kept) == b""
    assert [tuple(s) for s in found[1].spans] == [(5, 5 + len(same))] and found[3].spans == []


def test_several_texts_of_one_id(spark):
    a, b = ("".join(f"{c}{i}," for i in range(200)) for c in "ab")
    rows = [(1, a), (1, b), (2, a), (None, b + a[:90]), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((tuple(x) for x in suffix_repeats.dedup(docs, width=100, with_text=False).collect()), key=repr) == brute(rows, 100)


def test_texts_that_one_polynomial_cannot_tell_apart(spark):
    """A Thue-Morse sequence of 2 ** 11 symbols and its complement have equal sums modulo 2 ** 64 for any odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << 11))
    rows = [(1, one), (2, one.translate({97: "b", 98: "a"})), (3, "c" * 2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(x) for x in suffix_repeats.dedup(docs, width=2000, with_text=False).collect()) == brute(rows, 2000)


def test_planted_passages(spark):
    """at the contract's width a passage of 50 words or more goes if it has 400 bytes, and n_removed tells it, not n_bytes."""
    r = random.Random(4)
    words = lambda n, size: " ".join("".join(r.choices("etaoinshrdlu", k=size)) for _ in range(n))
    long, short = words(60, 6), words(60, 5)
    assert len(long) >= suffix_repeats.WIDTH > len(short) + 2
    rows = [(i, f"{words(80, 7)} {passage or words(70, 7)} {words(30, 7)}") for i, passage in enumerate([long, short, None] * 2)]
    found = sorted(tuple(x) for x in suffix_repeats.dedup(spark.createDataFrame(rows, "doc_id long, text string"), with_text=False).collect())
    assert found == brute(rows, suffix_repeats.WIDTH)
    assert [x[2] > 0 for x in found] == [True, False, False] * 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_repeats.dedup(docs, width=30).collect() == []


def test_a_hundred_thousand_equal_rows(spark):
    """Equal rows are sorted as one, so their number costs no more than to read and to answer them."""
    same = "".join(f"w{i}," for i in range(400))
    many = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(same).alias("text"))
    docs = many.unionByName(spark.createDataFrame([(5, "left " + same), (6, "short"), (6, "short")], "doc_id long, text string"))
    found = suffix_repeats.dedup(docs, with_text=False).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()
    n = len(same)
    assert sorted(map(tuple, found), key=repr) == [(5, n + 5, n, 1, 1), (6, 5, 0, 0, 2), (None, n, n, 1, 100_000)]
