from __future__ import annotations

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from marlstream.sources.keyed import KeyedTable


def rows(df):
    return {r.k: r.v for r in df.collect()}


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, str(tmp_path / "t"), ["k"], buckets=32)


def frame(spark, pairs):
    return spark.createDataFrame(list(pairs), "k long, v string")


def folders(table):
    return {x for x in pathlib.Path(table.path, "data").glob("*/__bucket=*")}


def test_a_batch_writes_only_its_buckets(spark, table):
    table.upsert(spark.range(2000).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    before = folders(table)
    table.upsert(frame(spark, [(i * 7, "new") for i in range(9)] + [(5000, "more")]))
    assert len(before) == 32 and len(folders(table) - before) <= 10
    found = rows(table.read())
    assert len(found) == 2001 and {k for k, v in found.items() if v == "new"} == {i * 7 for i in range(9)} and found[5000] == "more"
    assert set(rows(table.read(1)).values()) == {"old"}


def test_failures_between_the_steps(spark, table, monkeypatch):
    table.upsert(frame(spark, [(1, "a"), (2, "b")]))

    def lost(*_):
        raise OSError("lost")

    for step in ("_publish", "_write"):
        with monkeypatch.context() as m:
            m.setattr(KeyedTable, step, lost)
            with pytest.raises(OSError, match="lost"):
                table.upsert(frame(spark, [(1, "half"), (3, "half")]))
        assert rows(table.read()) == {1: "a", 2: "b"} and table.versions() == [1]
    table.upsert(frame(spark, [(1, "c")]))
    assert rows(table.read()) == {1: "c", 2: "b"} and table.versions() == [1, 2]
    orphans = len(folders(table))
    table.vacuum()
    assert rows(table.read()) == {1: "c", 2: "b"} and len(folders(table)) < orphans and table.versions() == [2]


def test_batches_that_are_repeated(spark, table):
    for n in (0, 1, 1, 0):
        table.upsert(frame(spark, [(1, f"batch {n}")]), writer="w", batch=n)
    assert rows(table.read()) == {1: "batch 1"} and table.versions() == [1, 2]
    table.upsert(frame(spark, [(1, "other")]), writer="x", batch=0)
    assert rows(table.read()) == {1: "other"}


def test_against_a_dictionary(spark, table):
    r, now, states = random.Random(4), {}, {}
    for step in range(7):
        change = {r.choice([*range(20), None]): f"{step}-{i}" for i in range(6)}
        version = table.upsert(frame(spark, change.items()))
        now = now | change
        if step == 3:
            version = table.delete(frame(spark, [(3, ""), (None, "")]))
            now = {k: v for k, v in now.items() if k not in (3, None)}
        if step == 5:
            before = states[2][1]
            version = table.reset(frame(spark, [(k, "") for k in (0, 1, 2, None, 77)]), states[2][0])
            now = {k: v for k, v in now.items() if k not in (0, 1, 2, None)} | {k: v for k, v in before.items() if k in (0, 1, 2, None)}
            version = table.compact(most=2)
        states[step] = (version, now)
        assert rows(table.read()) == now
    for version, then in states.values():
        assert rows(table.read(version)) == then
    assert all(len(f) <= 2 for f in table.manifest()["buckets"].values())
    table.vacuum(keep=1)
    assert rows(table.read()) == now
    with pytest.raises(ValueError, match="isn't there"):
        table.read(1)


def test_equal_keys_in_a_batch_and_other_columns(spark, table):
    df = spark.createDataFrame([(1, "b", 2), (1, "a", 3), (None, "n", 1)], "k long, v string, at int")
    table.upsert(df, order="at")
    assert rows(table.read()) == {1: "a", None: "n"}
    table.upsert(df.withColumn("extra", F.lit(1)).where("k = 1 AND at = 2"))
    assert table.read().columns == ["k", "v", "at"] and rows(table.read())[1] == "b"
    table.upsert(df.where("k > 9"))
    assert table.read().count() == 2 and sorted((x.k or 0, x.version, x.gone) for x in table.history().collect()) == [(0, 1, False), (1, 1, False), (1, 2, False)]
    with pytest.raises(ValueError, match="keys"):
        KeyedTable(spark, table.path, ["v"], 32).upsert(df)
