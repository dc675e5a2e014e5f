"""The pipeline against the brute-force versions of its stages, applied one after the other."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import sentencepiece
import test_language
import test_leaks
import test_line_copies
import test_near_copies

import corpus_pipeline
from marlstream.llm import language, leaks, line_copies, pieces


def corpus():
    r = random.Random(11)
    speak = {"en": "the and of with over house tree water green stone".split(), "de": "der und nicht mit über haus baum wasser grün stein".split()}
    line = lambda lang, n: " ".join(r.choice(speak[lang]) for _ in range(n))
    items = [(1, "this very passage is part of a benchmark and must not be learnt by heart"), (2, "noch ein stück das niemand auswendig lernen soll weil es geprüft wird")]
    rows = []
    for i in range(40):
        lang = r.choice(sorted(speak))
        rows.append([i, "\n".join(line(lang, r.randint(4, 14)) for _ in range(r.randint(1, 6))), lang, "s", 0])
    for i in range(40, 55):
        copy = list(r.choice(rows[:40]))
        words = copy[1].split(" ")
        words[r.randrange(len(words))] = "changed"
        rows.append([i, " ".join(words) + ("\n" + line("en", 9) if i % 2 else ""), copy[2], "s", 0])
    rows += [[60, None, "en", "s", 0], [61, "", "en", "s", 0], [62, "12 34 !!", "en", "s", 0], [63, line("en", 20) + " " + items[0][1].upper() + " " + line("en", 5), "en", "s", 0], [64, line("de", 15) + "\n" + items[1][1].replace("geprüft", "gepruft"), "de", "s", 0], [65, rows[3][1], None, None, None]]
    long = line("en", 60).split(" ")
    rows += [[70, " ".join(long), "en", "s", 0], [71, " ".join(["first", *long[1:-1], "last"]), "en", "s", 0]]
    return [tuple(x) for x in rows], items


def expected(rows, items, train):
    langs = sorted({lang for lang, _ in train})
    has_letter = lambda t: any(c.isalpha() for c in t or "")
    bits = lambda t: min(test_language.brute_bits(train, language.ORDER, lang, t) for lang in langs) / len(t.encode())
    docs = [(i, t) for i, t in rows if has_letter(t) and bits(t) < language.UNLIKE_ANY]
    digests = {x[0]: x for x in test_line_copies.brute(docs)}
    gone = lambda i, t: keep_lines(docs, i, t)
    docs = [(i, gone(i, t)) for i, t in docs]
    assert all(hashlib.sha256(t.encode()).hexdigest() == digests[i][3] for i, t in docs)
    docs = [(i, t) for i, t in docs if digests[i][2] == 0 or t.split()]
    kept = {x[0] for x in test_near_copies.brute(docs) if x[3]}
    docs = [(i, t) for i, t in docs if i in kept]

    def leaks_in(t):
        for _, item in items:
            n = len(test_leaks.fold(item))
            if test_leaks.brute(item, t) <= min(int(n * leaks.EDIT_SHARE), (n - leaks.Q) // leaks.Q):
                return True
        return False

    return [(i, t) for i, t in docs if not leaks_in(t)]


def keep_lines(docs, i, text):
    lines = [((j, no), test_line_copies.words(x)) for j, t in docs for no, x in enumerate(t.split("\n"))]
    return "\n".join(x for no, x in enumerate(text.split("\n")) if not test_line_copies.words(x) or not any(p < (i, no) and test_line_copies.near(w, test_line_copies.words(x)) for p, w in lines if w))


def test_run_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    train = [(x.lang, x.text) for x in language.training_rows(docs).collect()]
    want = dict(expected([(r[0], r[1]) for r in rows], items, train))
    assert 10 < len(want) < len(rows) - 6 and 70 in want and not want.keys() & {60, 61, 62, 63, 64, 71}
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_PATH)
    found = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {i: list(x.ids) for i, x in found.items()} == {i: library.encode(t) for i, t in want.items()}
    assert all(x.round_trip and x.ids_sha256 == hashlib.sha256(np.array(list(x.ids), "<u4").tobytes()).hexdigest() for x in found.values())


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows[:8], "doc_id long, text string, lang string, source string, n_chars long")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and line_copies is not None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.where("doc_id > 99"), str(tmp_path)).collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("doc_id > 99"), str(tmp_path)).collect() == []
