from __future__ import annotations

import random
import struct
import sys

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from marlstream.llm import pieces


def texts():
    r = random.Random(7)
    alphabet = "etaoin shrdlu ETA éüñ日本語😀\t\n▁.,-_0123456789<>\x00​"
    found = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(300)]
    found += ["", " ", "  ", " a  b   c ", "▁", "▁▁x", "\n\n", "a" * 300, " " * 50, "<s>", "<0x41>", "</s> <unk>", "𝔘𝔫𝔦", "é", "é", "The quick brown fox", "internationalisation", "x" + "ab" * 2000, "1" * 70]
    return found


def test_ids_equal_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame([*rows, (9999, None)], "doc_id long, text string").withColumn("decoded", F.lit("clash")).repartition(3)
    coded = pieces.decode(pieces.encode(docs))
    found = {x.doc_id: x for x in coded.collect()}
    for i, text in rows:
        want = library.encode(text)
        assert list(found[i].ids) == want, repr(text)
        assert found[i].decoded == library.decode(want), repr(text)
    assert list(found[9999].ids) == []


def test_round_trips(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    want = {x.doc_id: library.encode(x.text) for x in docs.collect()}
    found = {x.doc_id: x for x in pieces.round_trips(docs, with_ids=True).collect()}
    assert {i: list(x.ids) for i, x in found.items()} == want and all(x.round_trip and x.n_tokens == len(x.ids) for x in found.values())


def test_bytes_that_are_no_text(spark):
    t = pieces.Transducer(pieces.model_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)


    for ids in ([], [3], [200, 201, 5], [0, 1, 2], [259, 1234, 230]):
        assert t.decode(np.array(ids, np.int64)) == library.decode(ids)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "a b"), (3, "a b")], "doc_id long, text string")
    found = pieces.round_trips(docs).collect()
    assert len(found) == 5 and all(x.round_trip for x in found) and pieces.round_trips(docs.where("doc_id > 9")).collect() == []
    assert [x.decoded for x in pieces.decode(spark.createDataFrame([(None,)], "ids array<int>")).collect()] == [None]


def ids_of(t, text):
    return np.frombuffer(t.encode(text), "<u4").tolist()


def test_long_runs_and_texts_without_spaces():
    """Texts of megabytes that are one part end soon, with the library's ids."""
    t = pieces.Transducer(pieces.model_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(1)
    for k in (*range(1, 70), 1000):
        for text in (" " * k, " " * k + "the", "x" + " " * k + "日本" + " " * (k // 2)):
            assert ids_of(t, text) == library.encode(text)
    base64 = "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=2_000_000))
    for text in (" " * 10_000_000, "".join(r.choices("日本語中文字漢天地人大小山川", k=3_400_000)), base64, "a" * 1_000_000):
        assert ids_of(t, text) == library.encode(text)
    assert t.kept_bytes <= 2 * pieces.KEPT_BYTES


def message(*fields):
    """A protocol-buffer message of (number, value)."""

    def varint(x):
        return bytes([x & 127 | 128]) + varint(x >> 7) if x > 127 else bytes([x])

    out = b""
    for number, value in fields:
        if isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        elif isinstance(value, int):
            out += varint(number << 3) + varint(value)
        else:
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


def unigram_model(byte_fallback):
    """Pieces with scores drawn at random, so that many segmentations compete."""
    r = random.Random(5)
    names = {c for c in "▁abcdeé日"} | {"".join(r.choice("▁abcdé") if i == 0 else r.choice("abcdé") for i in range(r.randint(2, 5))) for _ in range(150)} | {"▁▁"}
    listed = [message((1, b"<unk>"), (2, 0.0), (3, 2)), message((1, b"<s>"), (2, 0.0), (3, 3)), message((1, b"</s>"), (2, 0.0), (3, 3))]
    if byte_fallback:
        listed += [message((1, f"<0x{b:02X}>".encode()), (2, 0.0), (3, 6)) for b in range(256)]
    listed += [message((1, x.encode()), (2, -r.uniform(1, 12)), (3, 1)) for x in sorted(names)]
    return listed, message((3, 1), (35, int(byte_fallback)))


@pytest.mark.parametrize("byte_fallback", [False, True])
@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc_cf"])
@pytest.mark.parametrize("fewer_spaces", [False, True])
def test_unigram_models_and_normalisers(byte_fallback, rule, fewer_spaces):
    listed, trainer = unigram_model(byte_fallback)
    charsmap = dict(pieces._fields(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())).get(2, b"")
    normaliser = message((1, rule.encode()), (2, charsmap), (3, 1), (4, int(fewer_spaces)), (5, 1))
    model = message(*[(1, x) for x in listed], (2, trainer), (3, normaliser))
    library = sentencepiece.SentencePieceProcessor(model_proto=model)
    t = pieces.Transducer(model)
    r = random.Random(2)
    for text in [*["".join(r.choice("aabbccddeé日 zß①ﬁÅA\t~") for _ in range(r.randint(0, 60))) for _ in range(300)], "", " ", "  a  b  ", "abcde" * 30_000, " " * 300 + "ab"]:
        want = library.encode(text)
        assert ids_of(t, text) == want, repr(text[:80])
        assert t.decode(np.array(want, np.int64)) == library.decode(want)


def test_short_parts_are_searched_together():
    """no Python call for each word; ids, kept and not kept, equal the library's."""
    t = pieces.Transducer(pieces.model_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    r = random.Random(3)
    word = lambda: "".join(r.choice("etaoinshrdlué日😀") for _ in range(r.randint(1, 12)))
    words = [word() for _ in range(20_000)]
    assert ids_of(t, " ".join(words)) == library.encode(" ".join(words))
    again = " ".join(w[::-1] + w for w in words)
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_name not in ("merged", "_stay", "follows", "varint")

    sys.setprofile(count)
    try:
        found = t.encode(again)
    finally:
        sys.setprofile(None)
    assert np.frombuffer(found, "<u4").tolist() == library.encode(again)
    assert calls < 10_000
    mixed = [*texts(), "é" * 199 + " " + "é" * 200 + " " + "日" * 201 + " 😀x", again[:50_000]]
    assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_all(mixed)] == [library.encode(x) for x in mixed]


def test_large_texts_in_runs_of_parts(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_PARTS", 50)
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    t = pieces.Transducer(pieces.model_bytes())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    large = " ".join(f"{i} w{i * 7919}" for i in range(2000))
    for some in ([large], [*texts(), large, large[:500]], texts()):
        assert [np.frombuffer(x, "<u4").tolist() for x in t.encode_all(some)] == [library.encode(x) for x in some]
        assert pieces.ENTRY_BYTES * (len(t.kept) + len(t.older)) <= 3 * pieces.KEPT_BYTES


def test_lookup_of_numbers():
    r = np.random.default_rng(1)
    keys = r.choice(1 << 40, 3000, replace=False)
    found = pieces.Lookup(1000)
    for part in np.split(keys, 6):
        found.put(part, (part % 1000).astype(np.int32))
        assert (found.get(part) == part % 1000).all() and (found.get(part + (1 << 41)) == -1).all() and found.n <= 1000
    assert len(found.get(keys[:0])) == 0
