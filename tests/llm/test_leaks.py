from __future__ import annotations

import math
import random
import tracemalloc

from pyspark.sql import functions as F

from marlstream.llm import leaks


def fold(text):
    return "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text.casefold())


def brute(item, text):
    """Fewest edits that turn the item into some stretch of the text (free ends at the text's side)."""
    a, b = fold(item), fold(text)
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(r.choice([4, 10, 20, 40]))) for i in range(12)]
    docs = []
    for i in range(60):
        parts = [text(r.randint(0, 30))]
        for _ in range(r.choice([0, 1, 1, 2])):
            leak = list(r.choice(items)[1])
            for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
                at, kind = r.randrange(len(leak)), r.randrange(3)
                leak[at : at + (kind != 1)] = [] if kind == 0 else ["z"]
            leak = "".join(leak)
            parts += [leak.upper() if r.random() < 0.2 else leak.replace(" ", "\n") if r.random() < 0.2 else leak, text(r.randint(0, 30))]
        docs.append((i, " ".join(parts)))
    return items, docs


def test_against_brute_force(spark, monkeypatch):
    for seed, block in ((1, 4_000_000), (2, 500)):
        monkeypatch.setattr(leaks, "BLOCK_CHARS", block)
        items, docs = corpus(seed)
        found = leaks.find(spark.createDataFrame(docs, "doc_id long, text string").withColumn("edits", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string"))
        got = {x.doc_id: dict(zip(x.item_ids, x.edits, strict=True)) for x in found.collect()}
        for i, text in docs:
            want = {}
            for j, item in items:
                n = len(fold(item))
                k = min(int(n * leaks.EDIT_SHARE), (n - leaks.Q) // leaks.Q)
                if n >= leaks.MIN_CHARS and (e := brute(item, text)) <= k:
                    want[j] = e
            assert got[i] == want


def test_odd_rows(spark):
    item = "this passage is long enough to be told from chance by anyone"
    benchmark = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short"), (None, item + "!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + item), (1, "x " + item), (2, None), (3, ""), (4, "clean"), (5, item[:20])], "doc_id long, text string")
    found = sorted((x.doc_id, x.item_ids) for x in leaks.find(docs, benchmark).collect())
    assert found == [(1, [1, 2]), (1, [1, 2]), (2, []), (3, []), (4, []), (5, [])]
    assert leaks.find(docs, benchmark.where("item_id > 9")).where(F.size("item_ids") > 0).count() == 0
    assert leaks.find(docs.where("doc_id > 9"), benchmark).collect() == []


def brute_share(item, text):
    """Share of the item's characters that lie in stretches found in the text."""
    x = fold(item)
    length = max(leaks.MIN_CHARS, min(leaks.STRETCH, math.ceil(len(x) * leaks.QUOTED_SHARE)))
    k = min(int(length * leaks.EDIT_SHARE), (length - leaks.Q) // leaks.Q)
    held = {p for s in range(len(x) - length + 1) if brute(x[s : s + length], text) <= k for p in range(s, s + length)}
    return len(held) / len(x)


def test_quoted_parts_against_brute_force(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(n)) for i, n in enumerate((9, 12, 16, 25, 34))]
    docs = []
    for i in range(16):
        item, parts = r.choice(items)[1], [text(4)]
        for _ in range(r.choice([1, 1, 2])):
            a = r.randrange(len(item) // 2)
            part = list(item[a : a + r.randint(len(item) // 3, len(item))])
            for _ in range(r.choice([0, 0, 1, 3, 6])):
                part[r.randrange(len(part))] = "z"
            parts += ["".join(part).upper() if r.random() < 0.2 else "".join(part), text(3)]
        docs.append((i, " ".join(parts)))
    found = leaks.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    some = 0
    for x in found.collect():
        want = {j: share for j, item in items if j not in x.item_ids and len(fold(item)) >= leaks.MIN_CHARS and (share := brute_share(item, docs[x.doc_id][1])) >= leaks.QUOTED_SHARE}
        assert dict(zip(x.quoted_ids, x.quoted_shares, strict=True)) == want
        some += bool(want)
    assert 2 < some < 14


def test_item_without_its_middle_line_is_dropped(spark, tmp_path):
    lines = ["the first line of the item is long enough for anyone to tell", "a middle line goes", "the last line of the item says something else again, at length"]
    spark.createDataFrame([(1, "\n".join(lines))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, f"{lines[0]}\n{lines[2]}"), (2, "first of the line, item long to tell " * 4), (3, lines[1]), (4, lines[0][:45] + " and so on")], "doc_id long, text string")
    assert sorted(x.doc_id for x in leaks.drop_leaks(spark, docs, str(tmp_path)).collect()) == [2, 3, 4]
    loose = leaks.find(docs, spark.read.parquet(str(tmp_path / "benchmark.parquet")), share=0.25)
    assert sorted(x.doc_id for x in loose.where(F.size("quoted_ids") > 0).collect()) == [1, 4]


def test_counting_goes_on_from_chunk_to_chunk(monkeypatch):
    items, docs = corpus(4)
    known = leaks.Items(items)
    want = [known.leaks(text) for _, text in docs]
    assert any(whole for whole, _ in want) and any(parts for _, parts in want)
    for pairs in (1, 7, 60):
        monkeypatch.setattr(leaks, "PAIRS", pairs)
        assert [known.leaks(text) for _, text in docs] == want


def test_long_texts_of_few_q_grams():
    """Hits of a text and an item with the same few q-grams would be 10 ** 8 pairs at once."""
    item = "ab" * 500
    known = leaks.Items([(1, item), (2, "a" * 280 + "bcd" * 20), (3, "-" * 300), (4, "-" * 120 + "what is asked here is not in any text")])
    tracemalloc.start()
    assert known.leaks("ab" * 100_000) == ({0: 0}, {})
    # 120 dashes and as many characters more as a stretch of 50 may have edits
    assert known.leaks("-" * 100_000 + " x") == ({2: 0}, {3: 123 / 157})
    # each stretch of the first item is quoted, though all of it isn't
    assert known.leaks("ba" * 200 + "c" * 1000) == ({}, {0: 1.0})
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_short_items_by_parameter(spark):
    benchmark = spark.createDataFrame([(1, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "here are two words"), (2, "here is one")], "doc_id long, text string")
    assert {x.doc_id: x.item_ids for x in leaks.find(docs, benchmark, min_chars=8).collect()} == {1: [1], 2: []}
    assert all(not x.item_ids for x in leaks.find(docs, benchmark).collect())
