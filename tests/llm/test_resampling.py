from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstream.llm import resampling, runs

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(rows, target, percent=25):
    """rows of (doc_id, text), without rows equal in both."""
    s, t = (Counter(b for x in texts for b in features(x)) for texts in ([x for _, x in rows], target))
    total_s, total_t = s.total() + 10000, t.total() + 10000
    gain = lambda b: math.floor(1000 * math.log(float(t[b] + 1) * float(total_s) / (float(s[b] + 1) * float(total_t))))
    out = []
    for i, text in rows:
        f = features(text)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    enough = sorted((x for x in out if x[1] >= 39), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    rank = {x[0]: k + 1 for k, x in enumerate(enough[: percent * len(enough) // 100])}
    return sorted(((*x, rank.get(x[0]) if x[1] >= 39 else None) for x in out), key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["Alpha", "beta", "été", "ÉTÉ", "x1", "日本", "a", "ÅB"])
    text = lambda n: "".join(word() + r.choice([" ", ", ", "\n", "_", "é"]) for _ in range(n))
    rows = [(i, text(r.choice([0, 1, 19, 20, 21, 60]))) for i in range(60)]
    return [*rows, (70, None), (71, ""), (72, "..."), (None, text(40)), (73, "long" * 3000 + " " + text(2000))], [text(30) for _ in range(5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(resampling, "BLOCK", 256)
    rows, target = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("weight", F.lit("clash")).repartition(3)
    found = resampling.ranked(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted((tuple(x) for x in found.drop("row").collect()), key=repr) == brute(rows, target)


def test_equal_rows_are_drawn_one_by_one(spark):
    docs = spark.createDataFrame([(1, "a b " * 20)] * 200 + [(None, "c d " * 20)] * 200, "doc_id long, text string").repartition(5)
    found = resampling.ranked(docs, docs.where("doc_id = 1")).collect()
    assert len(found) == 400 and sorted(x.rank for x in found if x.rank is not None) == list(range(1, 101))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two " * 15)], "doc_id long, text string")
    none = docs.where("doc_id > 9")
    assert resampling.ranked(none, docs).collect() == []
    assert [(x.n_features, x.rank) for x in resampling.ranked(docs, none, 100).collect()] == [(59, 1)]
    assert resampling.bucket_counts(spark.createDataFrame(spark.sparkContext.emptyRDD(), docs.schema)).sum() == 0


def test_drawn_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 25, "k", i) for i in range(8)], "doc_id long, text string, row string, n_features long")
    drawn = resampling.resampled(docs, docs, percent=50)
    assert drawn.columns == docs.columns and drawn.count() == 4 and {x.row for x in drawn.collect()} == {"k"}


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_runs_and_their_crcs(block):
    r = random.Random(block)
    texts = ["".join(r.choice(["a", "é", " ", ".", "x" * 60]) for _ in range(r.randint(0, 30))).encode() for _ in range(40)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    own = np.zeros(256, bool)
    own[[*range(97, 123), *range(128, 256)]] = True
    found = []
    for part, start, end, doc in runs.runs(data, offsets, lambda x: own[x], block):
        crc = runs.crcs(part, start, end)
        found += [(int(d), part[a:b].tobytes(), int(c)) for a, b, d, c in zip(start, end, doc, crc, strict=True)]
        both = runs.joined_crcs(crc[:-1], crc[1:], (end - start)[1:])
        assert [int(x) for x in both] == [zlib.crc32(part[a:b].tobytes() + part[c:d].tobytes()) for a, b, c, d in zip(start[:-1], end[:-1], start[1:], end[1:], strict=True)]
    assert found == [(k, w, zlib.crc32(w)) for k, t in enumerate(texts) for w in re.findall(rb"[a-z\x80-\xff]+", t)]
