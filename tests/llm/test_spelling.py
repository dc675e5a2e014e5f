from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marlstream.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows, damage=spelling.DAMAGE):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damage and h % damage == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    others = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w in n:
        if others[w]:
            best = min(others[w], key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(others[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def corpus(seed):
    """Chains of misspelt words, letters of both alphabets, letters that share a bit of the mask, and runs of one letter."""
    r = random.Random(seed)
    letters = "abcdeéÉßÀßàÿß"
    words = []
    for _ in range(40):
        w, n = "".join(r.choice(letters) for _ in range(r.choice([4, 5, 6, 9, 14]))), r.choice([3, 40])
        for _ in range(6):
            words += [w] * n
            n = max(1, n // 2)
            at = r.randrange(len(w)) if w else 0
            w = w or "a"
            w = w[:at] + r.choice(["", r.choice(letters), w[at] * 2]) + w[at + 1 :]
    words += ["aaaaa", "aaaaaa", "aaaaaaa"] * 4
    r.shuffle(words)
    rows = [(i, "".join(w.upper() if r.random() < 0.1 and w.isascii() else w + r.choice([" ", "-", "1", "\n", "Œ"]) for w in words[k : k + 20])) for i, k in enumerate(range(0, len(words), 20))]
    return [*rows, (900, None), (901, ""), (None, rows[0][1]), (0, rows[0][1]), (0, rows[0][1])]


@pytest.mark.parametrize(("seed", "damage"), [(1, 97), (2, 3), (3, None)])
def test_against_brute_force(spark, seed, damage):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).repartition(3)
    found = sorted((tuple(x) for x in spelling.grouped(docs, damage=damage).collect()), key=repr)
    assert len(found) > 20 and found == brute(rows, damage)


def test_every_edit_is_found_at_every_place(spark):
    base = ["abcdeabcde", "zzzzzzz", "éàbcéàb"]
    words = {*base}
    for w in base:
        for i in range(len(w) + 1):
            words |= {w[:i] + "x" + w[i:], w[:i] + "à" + w[i + 1 :], w[:i] + w[i + 1 :]}
    df = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    pairs = [tuple(sorted((x.a, x.b))) for x in spelling.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == {tuple(sorted((v, w))) for v in words for w in words if v < w and near(v, w)}


def test_empty_table_and_long_words(spark):
    docs = spark.createDataFrame([(1, "x" * 3_000_000 + " hello hello hello"), (2, "hello " * 400_000)], "doc_id long, text string")
    assert spelling.grouped(docs.where("doc_id > 9")).collect() == []
    assert [(x.word, x.n) for x in spelling.grouped(docs).collect()] == [("hello", 400_003)]
