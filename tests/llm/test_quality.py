from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstream.llm import quality


def test_gradients_are_those_of_the_loss():
    r = np.random.default_rng(3)
    doc = np.array([0, 0, 0, 1, 2, 2])
    edge, y, weight = np.array([0, 3, 4]), np.array([1.0, 0, 1]), np.array([0.5, 0.2, 0.3])
    x = r.normal(size=(6, 4))
    p = {"w": r.normal(size=(4, 5)), "v": r.normal(size=(5, 3)), "u": r.normal(size=(5, 3)), "a": r.normal(size=3), "c": r.normal(size=5), "b": r.normal(size=5), "d": np.array(0.1)}

    def loss(q):
        total = 0.0
        for k in range(3):
            h = np.maximum(0, x[doc == k] @ q["w"] + q["b"])
            e = np.exp((np.tanh(h @ q["v"]) / (1 + np.exp(-(h @ q["u"])))) @ q["a"])
            s = 1 / (1 + np.exp(-((e[:, None] * h).sum(axis=0) / e.sum() @ q["c"] + q["d"])))
            total -= weight[k] * (y[k] * np.log(s) + (1 - y[k]) * np.log(1 - s))
        return total

    found = quality._gradients(p, x, doc, edge, y, weight)
    for name, value in p.items():
        for at in np.ndindex(value.shape):
            up, down = ({**p, name: value.copy()} for _ in range(2))
            up[name][at] += 1e-6
            down[name][at] -= 1e-6
            assert abs((loss(up) - loss(down)) / 2e-6 - found[name][at]) < 1e-6


def naive(text):
    """The features of one text, passage by passage."""
    data = text.encode()
    out = []
    for at in range(0, max(1, len(data)), quality.PASSAGE):
        part = data[at : at + quality.PASSAGE]
        counts = np.zeros((quality.CLASSES, quality.CLASSES))
        for a, b in zip(part, part[1:]):
            counts[quality._CLASS[a], quality._CLASS[b]] += 1
        out.append(np.sqrt(counts / max(1, counts.sum())).ravel())
    words, at = [], 0
    for w in data.replace(b"\t", b" ").replace(b"\n", b" ").split(b" "):
        if w:
            words.append((at, w))
        at += len(w) + 1
    stats = []
    for k in range(len(out)):
        own = [(i, w) for i, (start, w) in enumerate(words) if start // quality.PASSAGE == k]
        n, m = max(1, len(own)), len(own)
        size = [len(w) for _, w in own]
        back = lambda j: sum(i >= j and words[i - j][1] == w for i, w in own)  # noqa: B023, E731
        two = len({(words[i - 1][1] if i else None, w) for i, w in own})
        stats.append([back(1) / n, back(2) / n, len({w for _, w in own}) / n, two / n, sum(size) / n / 10, np.log1p(sum(s * s for s in size) / n) / 5, m / quality.PASSAGE])
    return np.hstack([np.array(out), np.array(stats)])


def test_features_against_a_text_at_a_time():
    r = random.Random(5)
    texts = ["", "a", " ", "é" * 300] + ["".join(r.choice(["the ", "THE ", "a1, ", "é\n", "!! ", "| x", "w" * 30 + " "]) for _ in range(r.randint(1, 400))) for _ in range(12)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    x, doc = quality.encoded(data, np.cumsum([0, *(len(t.encode()) for t in texts)]))
    for k, t in enumerate(texts):
        # the word before the first of a text belongs to another text; the pair it makes is as good as none
        assert np.allclose(x[doc == k], naive(t), atol=1e-6), t


def corpus(spark, n=400):
    r = random.Random(9)
    good = lambda: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(r.randint(30, 300))) + "."
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 3
        # a bad document is mostly fine: a passage of it isn't
        rows.append((i, good() + (" " + "BUY!! NOW!! " * 60 if bad else "") + good()))
        labels.append((i, int(not bad)))
    rows += [(n, None), (n + 1, ""), (None, "a b"), (n + 2, good() * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy_and_attention(spark):
    docs, labels = corpus(spark)
    model = quality.train(docs.repartition(3), labels)
    found = {x.doc_id: x for x in quality.scored(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()}
    held = [x for i, x in found.items() if i is not None and i < 400 and x.held]
    assert {x.doc_id for x in held} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum((x.score >= 0.3) == (x.doc_id % 5 != 3) for x in held) >= 0.97 * len(held)
    assert all(0 <= x.score <= 1 for x in found.values()) and found[None].n_passages == 1 and found[400].n_passages == 1
    text = found[3].text.encode()
    x, _ = quality.encoded(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    _, attention = model.passages(x)
    assert b"BUY!!" in text[int(attention.argmax()) * quality.PASSAGE :][: quality.PASSAGE]
    again = {x.doc_id: x.score for x in quality.scored(docs.repartition(7), model).collect()}
    assert again == {i: x.score for i, x in found.items()} or max(abs(again[i] - found[i].score) for i in found) < 1e-9


def test_a_long_text_is_scored_in_blocks(spark, monkeypatch):
    text = "one two three " * 400
    data = np.frombuffer(text.encode(), np.uint8)
    monkeypatch.setattr(quality, "BLOCK", 1024)
    import pyarrow as pa

    parts = list(quality._blocks(pa.RecordBatch.from_pydict({"text": pa.array(["x", text, "y", "z"])}), "text"))
    assert [row for row, _, _ in parts] == [0, *[1] * 6, 2] and sum(len(d) for r, d, _ in parts if r == 1) == len(data)


@pytest.mark.parametrize("labelled", [[], [(1, 1), (2, 1)]])
def test_labels_of_one_kind(spark, labelled):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame(labelled, "doc_id long, quality int")
    found = quality.scored(docs, quality.train(docs, labels))
    assert {x.score for x in found.collect()} == {1.0 if labelled else 0.5}
    assert quality.scored(docs.where("doc_id > 9"), quality.train(docs, labels)).collect() == []


def test_repeated_rows_and_conflicting_labels(spark):
    docs = spark.createDataFrame([(1, "same text")] * 5000 + [(2, "other!! text!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None)], "doc_id long, quality int")
    rows = quality.training_rows(docs, labels).collect()
    assert sorted((x.doc_id, x.quality) for x in rows) == [(1, 1), (2, 0)]
