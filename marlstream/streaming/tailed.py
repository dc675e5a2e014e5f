"""A stream of the lines of a log that grows, by byte offset; the log may be switched while the stream runs.

    spark.dataSource.register(TailSource)
    spark.readStream.format("marlstream_tail").option("path", "/logs/a.log").load()
    spark.readStream.format("marlstream_tail").option("control", "/logs/current.txt").load()

An offset is (path, byte), the byte always being the first of a line: a line without its end is held back until it has one.
What is new is dealt to tasks in slices of SLICE bytes. With `control` the path is read from a file before each batch; after
a switch the old log is read to the end of its last whole line and the new one from its start. The checkpoint remembers the
offset, so a restart goes on at the same byte. A log that has become shorter was replaced and is read from its start. Paths
may be URIs of stores that pyarrow reads; driver and executors must see the same file. A log that isn't there yet is empty.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SLICE = 1 << 20


class Slice(InputPartition):
    """Lines of a log that start at `start` or later and before `stop`; none goes on behind `last`."""

    def __init__(self, path: str, begin: int, start: int, stop: int, last: int):
        self.path, self.begin, self.start, self.stop, self.last = path, begin, start, stop, last


def _opened(path: str):
    from pyarrow import fs

    if "://" in path:
        system, path = fs.FileSystem.from_uri(path)
    else:
        system, path = fs.LocalFileSystem(), os.path.abspath(path)
    return system.open_input_file(path)


def _lines_end(path: str, start: int) -> int:
    """Behind the last line end of a log, looking back from its end a slice at a time; `start` if there is none after it."""
    try:
        with _opened(path) as log:
            at = log.size()
            while at > start:
                below = max(start, at - SLICE)
                log.seek(below)
                found = log.read(at - below).rfind(b"\n")
                if found >= 0:
                    return below + found + 1
                at = below
            return start if log.size() >= start else -1
    except FileNotFoundError:
        return start if start == 0 else -1


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.control = options.get("path"), options.get("control")
        if (self.path is None) == (self.control is None):
            raise ValueError("one of the options path and control is needed")
        self.slice = int(options.get("slice", SLICE))
        self.known: dict = {}

    def _current(self) -> str:
        if self.control is None:
            return self.path
        try:
            with _opened(self.control) as f:
                return f.read().decode().strip()
        except FileNotFoundError:
            return ""

    def initialOffset(self) -> dict:
        return {"path": self._current(), "byte": 0}

    def latestOffset(self) -> dict:
        path = self._current()
        byte = self.known.get(path, 0)
        end = _lines_end(path, byte) if path else 0
        # shorter than before: another log of that name
        return {"path": path, "byte": _lines_end(path, 0) if end < 0 else end}

    def _slices(self, path: str, start: int, end: int):
        return [Slice(path, start, at, min(end, at + self.slice), end) for at in range(start, end, self.slice)]

    def partitions(self, start: dict, end: dict):
        self.known[end["path"]] = end["byte"]
        if start["path"] == end["path"]:
            return self._slices(end["path"], start["byte"] if end["byte"] >= start["byte"] else 0, end["byte"])
        rest = _lines_end(start["path"], start["byte"]) if start["path"] else 0
        return self._slices(start["path"], start["byte"], rest) + self._slices(end["path"], 0, end["byte"])

    def read(self, partition: Slice):
        at = partition.start
        with _opened(partition.path) as log:
            if at > partition.begin:
                # a line that began in the slice before belongs to it
                log.seek(at - 1)
                left = b""
                while at - 1 < partition.last:
                    chunk = log.read(min(SLICE, partition.last - at + 1))
                    found = chunk.find(b"\n")
                    if found >= 0:
                        at += found
                        break
                    at += len(chunk)
            log.seek(at)
            left = b""
            while at < partition.stop:
                chunk = log.read(min(SLICE, partition.last - at - len(left)))
                if not chunk:
                    return
                *lines, left = (left + chunk).split(b"\n")
                for line in lines:
                    if at >= partition.stop:
                        return
                    yield partition.path, at, line.removesuffix(b"\r").decode(errors="replace")
                    at += len(line) + 1

    def commit(self, end: dict) -> None:
        self.known[end["path"]] = end["byte"]


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marlstream_tail"

    def schema(self) -> str:
        return "path string, byte long, line string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)
