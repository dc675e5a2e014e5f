from __future__ import annotations

import hashlib
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstream.llm import line_copies

SPACES = " \t\x0b\x0c\r"


def words(line):
    for c in SPACES:
        line = line.replace(c, " ")
    return tuple(w for w in line.split(" ") if w)


def near(a, b):
    """If one word put in, left out or replaced, at most, makes them equal."""
    if a == b:
        return True
    if min(len(a), len(b)) < line_copies.MIN_WORDS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows):
    lines = [((i is not None, i or 0), no, words(x), k) for k, (i, t) in enumerate(rows) if t is not None for no, x in enumerate(t.split("\n"))]
    gone = {(k, no) for i, no, w, k in lines if w and any((j, m) < (i, no) and near(v, w) for j, m, v, _ in lines)}
    out = []
    for k, (i, t) in enumerate(rows):
        each = [] if t is None else t.split("\n")
        kept = None if t is None else "\n".join(x for no, x in enumerate(each) if (k, no) not in gone)
        out.append((i, len(each), sum((k, no) in gone for no in range(len(each))), None if kept is None else hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    r = random.Random(seed)
    word = lambda: r.choice(["alpha", "beta", "gamma", "delta", "é", "x1", "y"])
    base = [[word() for _ in range(r.choice([1, 3, 5, 6, 9, 14]))] for _ in range(12)]

    def line():
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            at = r.randrange(len(w)) if w else 0
            kind = r.randrange(3)
            if kind == 0:
                w[at : at + 1] = []
            elif kind == 1:
                w[at:at] = [word()]
            else:
                w[at : at + 1] = [word()]
        return r.choice([" ", "  ", "\t"]).join(w)

    rows = [(i, "\n".join(line() for _ in range(r.randint(1, 8)))) for i in range(25)]
    return [*rows, (90, ""), (91, None), (92, "\n\n"), (None, rows[0][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit("clash")).repartition(3)
    found = line_copies.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256))
    assert sorted((tuple(x) for x in found.collect()), key=repr) == brute(rows)


def test_sql_twin(spark, tmp_path):
    rows = [r for r in corpus(4) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    found = line_copies.op2_line_dedup(spark, str(tmp_path))
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    wanted = con.execute(line_copies.ORACLE["op2_line_dedup"]).fetchall()
    assert sorted((tuple(x) for x in found.collect()), key=repr) == sorted(wanted, key=repr)


def test_empty_table_and_stage(spark):
    docs = spark.createDataFrame([(1, "a b c\nx", "k"), (2, "a b c", "k"), (3, None, "k")], "doc_id long, text string, lang string")
    assert line_copies.dedup(docs.where("doc_id > 9")).collect() == []
    kept = line_copies.drop_repeated_lines(spark, docs, "")
    assert kept.columns == docs.columns and sorted((x.doc_id, x.text) for x in kept.collect() if x.doc_id != 3) == [(1, "a b c\nx")]


def test_one_text_of_100000_lines(spark):
    """Each line but the first of its kind goes; in a text of many lines none is found by splitting the text again."""
    text = "\n".join(f"at step {i // 2} the run of number {i // 2 % 977} went on with {'x' if i % 2 else 'y'} and no end" for i in range(100_000))
    found = line_copies.dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()[0]
    assert (found.n_lines, found.n_removed) == (100_000, 99_023) and found.text.split("\n")[-1] == "at step 976 the run of number 976 went on with y and no end"
