"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes, and only the document has a label. Each passage is encoded (how often
each pair of character classes follows one another, how words repeat, how long they are; nothing of a language), a dense
layer makes HIDDEN values of it, and gated attention, tanh times sigmoid, says how much it counts. The weighted mean of the
passages is scored by a logistic layer. All layers are learnt together from the documents' labels by gradient descent.

Learning uses a bounded sample: MAX_TRAINING_DOCS documents, half of either label where there are enough, weighted back to
the shares of all labels; texts of more than MAX_DOC_BYTES aren't learnt from, and a sample of more than
MAX_TRAINING_BYTES is thinned. The ids are drawn from the labels alone, so texts aren't shuffled. The model, some 40 kB, is
broadcast, and every whole text is scored in one pass; a long text's passages are added up block by block.

Defined cases: a null or empty text is one passage without words or characters; a null id is never learnt from and isn't held
out; an id with several labels has their rounded mean (halves up) and rows that repeat id and text are learnt from once; without
labels of both kinds to learn from, the score is the share of label 1 among them, or 0.5 without any; repeated rows get
equal scores; further columns can't clash, as only the named ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from marlstream.llm.arrow_text import batches_of, utf8
from marlstream.llm.common import dropped, table, written
from marlstream.llm.hashing import mixed, word_hashes, words

PASSAGE = 512
BLOCK = 1 << 20
HIDDEN = 32
GATES = 16
EPOCHS = 250
RATE = 0.01
DECAY = 1e-4
MAX_TRAINING_DOCS = 2000
MAX_TRAINING_BYTES = 16 << 20
MAX_DOC_BYTES = 256 << 10
THRESHOLD = 0.3

_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\r\n", ".", ",", "!?", ";:'\"-()", "@#$%&*+=^~", "|<>[]{}\\/_`")
CLASSES = len(_GROUPS) + 2  # and letters beyond ASCII, and control characters
_CLASS = np.full(256, CLASSES - 1, np.int64)
_CLASS[128:] = CLASSES - 2
for _i, _group in enumerate(_GROUPS):
    _CLASS[np.frombuffer(_group.encode(), np.uint8)] = _i
WIDTH = CLASSES * CLASSES + 7


def encoded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, text number) of all passages of some texts, in order; a text without bytes has one passage of zeros."""
    size = np.diff(offsets)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(size)), count)
    total = len(doc)
    out = np.zeros((total, WIDTH), np.float32)
    if not len(data):
        return out, doc
    of_byte = np.repeat(np.arange(len(size)), size)
    passage = first[of_byte] + (np.arange(len(data)) - offsets[of_byte]) // PASSAGE
    kind = _CLASS[data]
    same = passage[1:] == passage[:-1]
    pair = (kind[:-1] * CLASSES + kind[1:] + passage[:-1] * CLASSES * CLASSES)[same]
    counts = np.bincount(pair, minlength=total * CLASSES * CLASSES).reshape(total, -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(counts / np.maximum(1, counts.sum(axis=1, keepdims=True)))
    start, end, own = words(data, offsets)
    if not len(start):
        return out, doc
    at, value, length = passage[start], word_hashes(data, start, end), (end - start).astype(float)
    per = lambda weights=None: np.bincount(at, weights, total)
    n = np.maximum(1, per())
    before = lambda k: np.concatenate([np.zeros(min(k, len(at)), bool), (value[k:] == value[:-k]) & (own[k:] == own[:-k])])
    goes_on = np.concatenate([[False], own[1:] == own[:-1]])
    two = mixed(value + np.where(goes_on, np.roll(value, 1), np.uint64(0)) * np.uint64(3))
    distinct = lambda x: np.bincount(at[np.unique(mixed(x) ^ mixed(at.astype(np.uint64) + np.uint64(1)), return_index=True)[1]], minlength=total) / n
    out[:, CLASSES * CLASSES :] = np.stack([per(before(1)) / n, per(before(2)) / n, distinct(value), distinct(two), per(length) / n / 10, np.log1p(per(length * length) / n) / 5, per() / PASSAGE], axis=1)
    return out, doc


def _blocks(batch: pa.RecordBatch, column: str):
    """(first row, bytes, offsets): some texts at once, or a block of a text that is longer. How a text is cut depends on
    nothing but the text."""
    done = 0
    for some in batches_of(batch, column, BLOCK):
        data, offsets = utf8(some.column(column))
        if some.num_rows == 1 and len(data) > BLOCK:
            for at in range(0, len(data), BLOCK):
                part = data[at : at + BLOCK]
                yield done, part, np.array([0, len(part)])
        else:
            yield done, data, offsets
        done += some.num_rows


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Model:
    """Weights of all layers; without both labels only `share`, which all texts get."""

    def __init__(self, share: float = 0.5):
        self.share, self.w = share, None

    def fit(self, x: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Model:
        """x: passages in order of their documents' numbers `doc`; y and weight: of the documents."""
        r = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), 1 / (x.std(axis=0) + 0.05)
        x = ((x - self.mean) * self.scale).astype(np.float32)
        shape = {"w": (x.shape[1], HIDDEN), "v": (HIDDEN, GATES), "u": (HIDDEN, GATES), "a": (GATES,), "c": (HIDDEN,), "b": (HIDDEN,), "d": ()}
        p = {k: (r.normal(size=s) / np.sqrt(s[0]) if k not in "bd" else np.zeros(s)).astype(np.float32) for k, s in shape.items()}
        moments = {k: (np.zeros(s, np.float32), np.zeros(s, np.float32)) for k, s in shape.items()}
        edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        weight = weight / weight.sum()
        for epoch in range(1, epochs + 1):
            grad = _gradients(p, x, doc, edge, y, weight)
            for k, g in grad.items():
                g = g + DECAY * p[k]
                m, s = moments[k]
                m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
                moments[k] = (m, s)
                p[k] = (p[k] - RATE * (m / (1 - 0.9**epoch)) / (np.sqrt(s / (1 - 0.999**epoch)) + 1e-8)).astype(np.float32)
        self.__dict__.update(p)
        return self

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hidden values, unscaled attention) of encoded passages."""
        h = np.maximum(0, ((x - self.mean) * self.scale) @ self.w + self.b).astype(float)
        return h, np.exp((np.tanh(h @ self.v) * _sigmoid(h @ self.u)) @ self.a.astype(float))

    def score(self, weighted: np.ndarray, attention: np.ndarray) -> np.ndarray:
        return _sigmoid((weighted / attention[:, None]) @ self.c.astype(float) + float(self.d))


def _gradients(p: dict, x: np.ndarray, doc: np.ndarray, edge: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Of the weighted cross-entropy, in all layers."""
    h = np.maximum(0, x @ p["w"] + p["b"])
    t, s = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
    gate = t * s
    e = np.exp(gate @ p["a"])
    attention = e / np.add.reduceat(e, edge)[doc]
    z = np.add.reduceat(attention[:, None] * h, edge)
    off = weight * (_sigmoid(z @ p["c"] + p["d"]) - y)
    to_z = off[:, None] * p["c"]
    to_attention = (to_z[doc] * h).sum(axis=1)
    to_e = attention * (to_attention - np.add.reduceat(attention * to_attention, edge)[doc])
    to_gate = to_e[:, None] * p["a"]
    to_t, to_s = to_gate * s * (1 - t * t), to_gate * t * s * (1 - s)
    to_h = (attention[:, None] * to_z[doc] + to_t @ p["v"].T + to_s @ p["u"].T) * (h > 0)
    return {"w": x.T @ to_h, "b": to_h.sum(axis=0), "v": h.T @ to_t, "u": h.T @ to_s, "a": gate.T @ to_e, "c": z.T @ off, "d": off.sum()}


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _below(key: Column, share: Column) -> Column:
    return F.pmod(key, F.lit(1_000_000)) < share * 1_000_000


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCS) -> DataFrame:
    """(doc_id, row, text, quality, weight) of the sample."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    known = written(known)
    share = known.groupBy("quality").agg(F.least(F.lit(1.0), F.lit(most / 2) / F.count("*")).alias("share"))
    # a row for each label, then about `most` rows
    ids = written(known.join(F.broadcast(share), "quality").where(_below(F.xxhash64("doc_id"), F.col("share"))).select(F.col("doc_id").alias("__id"), "quality", (1 / F.col("share")).alias("weight")))
    own = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_DOC_BYTES).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("row"))
    rows = written(own.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).dropDuplicates(["doc_id", "row"]).drop("__id"))
    size = rows.agg(F.sum(F.octet_length("text") + PASSAGE)).first()[0] or 0
    dropped(known, ids)
    return rows.where(_below(F.xxhash64("doc_id", "row"), F.lit(min(1.0, MAX_TRAINING_BYTES / max(1, size)))))


def _encode(batches):
    for batch in batches:
        parts = {}
        for row, data, offsets in _blocks(batch, "text"):
            x, doc = encoded(data, offsets)
            for i in range(len(offsets) - 1):
                parts[row + i] = parts.get(row + i, b"") + x[doc == i].tobytes()
        passages = pa.array([parts[i] for i in range(batch.num_rows)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "row", "quality", "weight")] + [passages], ["doc_id", "row", "quality", "weight", "passages"])


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_DOCS) -> Model:
    rows = training_rows(docs.select(F.col("doc_id").cast("string"), "text"), labels.select(F.col("doc_id").cast("string"), "quality"), most)
    sample = rows.select("doc_id", "row", "quality", "weight", "text").mapInArrow(_encode, "doc_id string, row long, quality int, weight double, passages binary").toPandas().sort_values(["doc_id", "row"])
    y, weight = sample["quality"].to_numpy(float), sample["weight"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(float(y.mean()) if len(y) else 0.5)
    each = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in sample["passages"]]
    return Model().fit(np.concatenate(each), np.repeat(np.arange(len(each)), [len(x) for x in each]), y, weight)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with score and n_passages; the other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    new = ("score", "n_passages")
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in ("text", *new)], F.col("text").isNull().alias("__null"))
    asked = docs.select(F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))

    def run(batches):
        known = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            total, attention = np.zeros((batch.num_rows, HIDDEN)), np.zeros(batch.num_rows)
            for row, data, offsets in _blocks(batch, "text"):
                x, doc = encoded(data, offsets)
                to = slice(row, row + len(offsets) - 1)
                n[to] += np.bincount(doc, minlength=len(offsets) - 1)
                if known.w is not None:
                    h, a = known.passages(x)
                    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
                    total[to] += np.add.reduceat(a[:, None] * h, edge)
                    attention[to] += np.add.reduceat(a, edge)
            score = known.score(total, attention) if known.w is not None else np.full(batch.num_rows, known.share)
            yield pa.RecordBatch.from_arrays([batch.column("text"), batch.column("rest"), pa.array(score), pa.array(n)], ["text", "rest", *new])

    found = asked.mapInArrow(run, StructType([*asked.schema, StructField("score", DoubleType()), StructField("n_passages", LongType())]))
    own = {"text": F.when(~F.col("rest.__null"), F.col("text")).alias("text")}
    return found.select(*[own.get(c, F.col(f"rest.`{c}`")) for c in docs.columns if c not in new], *new)


def op12_quality_attention(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = scored(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_passages")


QUERIES = {"op12_quality_attention": op12_quality_attention}
