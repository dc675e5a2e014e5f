from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from marlstream.llm import language


def brute_bits(train, order, lang, text):
    """Code length by the definition, from plain dictionaries."""
    counts = defaultdict(lambda: defaultdict(int))
    kept = defaultdict(lambda: defaultdict(int))
    for l, t in train:
        if l == lang:
            data = b"\n" * order + t.encode()
            for i in range(order, len(data)):
                for k in range(order + 1):
                    counts[data[i - k : i]][data[i]] += 1
    for context, followers in counts.items():
        for byte, n in followers.items():
            if len(context) < 3 or n > 1:
                kept[context][byte] = n
    data, bits = b"\n" * order + text.encode(), 0.0
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            followers = kept.get(data[i - k : i])
            if not followers:
                continue
            total, kinds = sum(followers.values()), len(followers)
            if data[i] in followers:
                bits += math.log2((total + kinds) / followers[data[i]])
                break
            bits += math.log2((total + kinds) / kinds)
        else:
            bits += 8
    return bits


def corpus():
    r = random.Random(3)
    speak = {"aa": "the and of with over", "bb": "der und nicht mit über", "cc": "le et ñu avec çà"}
    rows = []
    for i in range(120):
        lang = r.choice(sorted(speak))
        rows.append((i, " ".join(r.choice(speak[lang].split()) for _ in range(r.randint(3, 30))), lang))
    return rows


def test_code_lengths_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("bits", F.lit("clash"))
    train = [(lang, text) for text, lang in language.training_rows(docs).collect()]
    models = language.train(docs)
    odd = [(500, "über the ñu"), (501, "x"), (502, "the " * 3000)]
    found = {x.doc_id: x for x in language.predict(spark.createDataFrame([(i, t) for i, t, _ in rows[:20]] + odd, "doc_id long, text string"), models).collect()}
    (model,) = models
    for i, t in [(i, t) for i, t, _ in rows[:20]] + odd:
        want = {lang: brute_bits(train, language.ORDER, lang, t) for lang in model.langs}
        best = min(sorted(want), key=lambda x: want[x])
        assert found[i].lang_pred == best and abs(found[i].bits * len(t.encode()) - want[best]) < 0.01 + 1e-4 * want[best]


def test_held_out_accuracy_and_no_peeking(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = {x.doc_id for x in docs.where(language.held_out(F.col("doc_id"))).collect()}
    assert 10 < len(held) < 60
    model = language.train(docs)
    found = {x.doc_id: x.lang_pred for x in language.predict(docs.select("doc_id", "text"), model).collect()}
    right = [found[i] == lang for i, _, lang in rows if i in held]
    assert sum(right) >= 0.95 * len(right)
    lied = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert [m.langs for m in language.train(lied)] == [m.langs for m in model]


def test_more_languages_than_at_once(spark, monkeypatch):
    """Passes of one language each give the result of one pass over all."""
    rows = corpus()
    docs = spark.createDataFrame([*rows, (600, "x y", None), (601, "", None)], "doc_id long, text string, lang string")
    told = lambda: sorted((x.doc_id, x.lang_pred, round(x.score, 9), round(x.bits, 6)) for x in language.predict(docs.select("doc_id", "text"), language.train(docs)).collect())
    want = told()
    monkeypatch.setattr(language, "LANGUAGES_AT_ONCE", 1)
    assert len(language.train(docs)) == 3 and told() == want


def test_many_languages_in_bounded_models(spark, monkeypatch):
    """Models and passes cut by their cells give the result of one pass; their cells grow with the languages."""
    rows = corpus()
    docs = spark.createDataFrame([*rows, (600, "x y", None), (601, None, None)], "doc_id long, text string, lang string")
    told = lambda: sorted((x.doc_id, x.lang_pred, round(x.score, 9), round(x.bits, 6)) for x in language.predict(docs.select("doc_id", "text"), language.train(docs)).collect())
    want = told()
    monkeypatch.setattr(language, "MODEL_CELLS", 1)
    monkeypatch.setattr(language, "PASS_CELLS", 1)
    assert [m.langs for m in language.train(docs)] == [["aa"], ["bb"], ["cc"]] and told() == want
    monkeypatch.setattr(language, "PASS_CELLS", 1 << 20)
    assert told() == want
    # 64 languages with words of their own
    r = random.Random(4)
    own = {f"l{i:02}": ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(40)] for i in range(64)}
    many = [(i, " ".join(r.choice(own[f"l{i % 64:02}"]) for _ in range(30)), f"l{i % 64:02}") for i in range(640)]
    docs = spark.createDataFrame(many, "doc_id long, text string, lang string")
    monkeypatch.setattr(language, "MODEL_CELLS", 40_000)
    models = language.train(docs)
    assert sum((m.langs for m in models), []) == sorted(own) and max(m.cells for m in models) <= 40_000 and len(models) > 4
    assert all(x.lang_pred == x.lang for x in language.predict(docs, models).collect())


def test_training_bytes_are_bounded(spark):
    """The byte bound holds for each language; a first text longer than it stays, equal rows aren't told apart."""
    rows = [(i, "x" * 100, "aa") for i in range(50)] + [(60, "y" * 5000, "aa"), (61, "z" * 5000, "bb"), (62, "w" * 6000, "bb")] + [(70, "v" * 90, "cc")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").where(~language.held_out(F.col("doc_id")))
    had, found = docs.groupBy("lang").count().collect(), defaultdict(list)
    for text, lang in language.training_rows(docs, most_bytes=1000).collect():
        found[lang].append(text)
    assert {x.lang for x in had} == set(found)
    assert found["aa"] == ["x" * 100] * 10 and ("bb" not in found or len(found["bb"]) == 1) and found.get("cc") in (None, ["v" * 90] * 3)


def test_training_texts_without_repeats(spark):
    """No gram of the highest orders is seen twice."""
    docs = spark.createDataFrame([(1, "abcdefg", "aa"), (2, "hijk", "bb"), (4, "ab", "aa"), (5, "xyz", None)], "doc_id long, text string, lang string")
    found = {x.doc_id: x.lang_pred for x in language.predict(docs, language.train(docs)).collect()}
    assert found[4] == "aa" and set(found.values()) <= {"aa", "bb"}
    stage = language.keep_known_languages(spark, docs, "")
    assert stage.columns == ["doc_id", "text", "lang"] and all(x.lang for x in stage.collect())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "aa"), (2, "", "aa"), (3, "123 !?", None), (None, "the and", "bb"), (4, "Ünï", None), (4, "Ünï", None)], "doc_id long, text string, lang string")
    model = language.train(docs)
    found = [(x.doc_id, x.lang_pred, x.score) for x in language.predict(docs, model).collect()]
    assert {(i, p) for i, p, _ in found if i in (1, 2, 3)} == {(1, "und"), (2, "und"), (3, "und")} and all(0 <= s <= 1 for _, _, s in found) and len(found) == 6
    empty = docs.where("doc_id > 99")
    assert language.predict(empty, language.train(empty)).collect() == []
    stage = language.keep_known_languages(spark, spark.createDataFrame(corpus() + [(900, "99", "aa"), (901, None, "aa")], "doc_id long, text string, lang string"), "")
    assert stage.columns == ["doc_id", "text", "lang"] and stage.count() == 120 and {x.lang for x in stage.collect()} == {"aa", "bb", "cc"}
