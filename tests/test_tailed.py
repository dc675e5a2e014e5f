from __future__ import annotations

import json

from pyspark.sql import functions as F

from marlstream.sources.keyed import KeyedTable
from marlstream.streaming import logs
from marlstream.streaming.tailed import Slice, TailReader, TailSource


def lines_of(reader, start, end):
    return [x for part in reader.partitions(start, end) for x in reader.read(part)]


def test_slices_of_any_size_give_each_line_once(tmp_path):
    log = tmp_path / "a.log"
    text = ["", "é" * 5, "x", "", "y" * 40, "z\r", "日本"]
    log.write_bytes("\n".join([*text, "half"]).encode())
    for size in (1, 2, 3, 7, 16, 1000):
        reader = TailReader({"path": str(log), "slice": str(size)})
        found = lines_of(reader, reader.initialOffset(), reader.latestOffset())
        assert [x[2] for x in found] == [t.removesuffix("\r") for t in text]
        assert [x[1] for x in found] == [len("".join(f"{t}\n" for t in text[:i]).encode()) for i in range(len(text))]
    assert list(reader.read(Slice(str(log), 0, 0, 0, 0))) == []


def test_growth_half_lines_replacement_and_switch(tmp_path):
    log, other, control = tmp_path / "a.log", tmp_path / "b.log", tmp_path / "control"
    reader = TailReader({"control": str(control)})
    start = reader.initialOffset()
    assert start == {"path": "", "byte": 0} and reader.latestOffset() == start
    control.write_text(f"{log}\n")
    assert (at := reader.latestOffset()) == {"path": str(log), "byte": 0} and lines_of(reader, start, at) == []
    log.write_text("one\ntw")
    now = reader.latestOffset()
    assert [x[2] for x in lines_of(reader, at, now)] == ["one"]
    log.write_text("one\ntwo\nthree")
    at, now = now, reader.latestOffset()
    assert [x[2] for x in lines_of(reader, at, now)] == ["two"]
    # a new reader, as after a restart, knows no more than the offsets
    reader = TailReader({"control": str(control)})
    other.write_text("first\nsecond\n")
    log.write_text("one\ntwo\nthree\nfour\n5")
    control.write_text(str(other))
    at, now = now, reader.latestOffset()
    assert [x[2] for x in lines_of(reader, at, now)] == ["three", "four", "first", "second"]
    other.write_text("new\n")
    at, now = now, reader.latestOffset()
    assert [x[2] for x in lines_of(reader, at, now)] == ["new"]


def line(minute, text):
    return json.dumps({"level": "info", "message": text, "timestamp": f"2024-01-01T00:{minute:02d}:00Z"}) + "\n"


def test_a_stream_over_restart_and_switch(spark, tmp_path):
    spark.dataSource.register(TailSource)
    log, other, control, out = tmp_path / "a.log", tmp_path / "b.log", tmp_path / "control", tmp_path / "out"
    control.write_text(str(log))

    def run():
        rows = logs.tail_bytes(spark, control=str(control))
        query = logs.append_to(rows, str(out), str(tmp_path / "cp"))
        query.processAllAvailable()
        query.stop()
        return sorted(r.message for r in spark.read.schema("message string").json(str(out)).collect())

    log.write_text("Log file created\n" + line(0, "a") + line(1, "b")[:20])
    assert run() == ["a"]
    log.write_text("Log file created\n" + line(0, "a") + line(1, "b") + line(2, "c"))
    assert run() == ["a", "b", "c"]
    with log.open("a") as f:
        f.write(line(3, "d"))
    other.write_text(line(4, "e"))
    control.write_text(str(other))
    assert run() == ["a", "b", "c", "d", "e"] == run()


def test_lines_that_come_twice_late_or_again(spark, tmp_path):
    one, two, out = tmp_path / "one", tmp_path / "two", str(tmp_path / "merged")
    one.mkdir(), two.mkdir()

    def run(folder, checkpoint):
        logs.once_into(logs.tail(spark, str(folder)), out, str(tmp_path / checkpoint), available_now=True).awaitTermination()
        return sorted(r.message for r in logs.read_once(spark, out).collect())

    (one / "1.log").write_text(line(50, "a") + line(51, "b") + line(51, "b"))
    assert run(one, "cp1") == ["a", "b"]
    (two / "1.log").write_text(line(51, "b") + line(1, "late"))
    assert run(two, "cp2") == ["a", "b", "late"]
    (one / "2.log").write_text(line(1, "late") + line(50, "a") + line(52, "c"))
    assert run(one, "cp1") == ["a", "b", "c", "late"]
    # a checkpoint that was lost brings everything again
    assert run(one, "cp3") == ["a", "b", "c", "late"]


def test_older_rows_do_not_replace_newer_ones(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], latest="at")
    for at in (5, 3, 9, 1):
        table.upsert(spark.createDataFrame([(1, at), (at, at)], "k int, at int"))
    assert {(r.k, r["at"]) for r in table.read().where(F.col("k") == 1).collect()} == {(1, 9)}
