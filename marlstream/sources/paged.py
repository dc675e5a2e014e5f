"""A batch source for paged services: pages are read side by side, the rows come as JSON texts.

    spark.dataSource.register(PagedSource)
    spark.read.format("marlstream_paged").option("provider", "package.module:function").option("total", 1234).load()
    paged_rows(spark, {"provider": "package.module:function"})            # the length isn't known

The provider takes (options, offset, limit) and returns the rows of that page; it runs on the executors. A page that
raises is asked for again, `attempts` times with `wait` seconds before the second and twice as many before each further
one; then the task fails, and Spark runs it again. A page is given to Spark when all of it is there, so no row is lost or
comes twice. `pages` of them make a task. With `per_second` the tasks together ask for no more pages a second, on
average, than that, if `slots` of them run at once.

Where the length isn't known, `paged_rows` looks for it in rounds on the executors: first at all powers of two, then at
PROBES places between the last that had a row and the first that had none. The service must have rows up to some place and none
from there on. Without `total`, the source itself reads in one task until a short page.
"""

from __future__ import annotations

import importlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 100
PROBES = 16
#: places beyond 2 ** FARTHEST aren't looked at
FARTHEST = 40


class PageRange(InputPartition):
    """Pages from an offset up to another, or until a short one."""

    def __init__(self, offset: int, end: int | None):
        self.offset, self.end = offset, end


def _asked(options: dict, offset: int, limit: int) -> list:
    """A page, after as many attempts as the options allow."""
    module, _, name = options["provider"].partition(":")
    provide = getattr(importlib.import_module(module), name)
    attempts, wait = int(options.get("attempts", 1)), float(options.get("wait", 1))
    for n in range(1, attempts + 1):
        try:
            return list(provide(options, offset, limit))
        except Exception:  # noqa: BLE001  whatever the service's client raises
            if n == attempts:
                raise
            time.sleep(wait * 2 ** (n - 1))
    raise ValueError("attempts must be 1 or more")


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.limit = int(options.get("limit", PAGE))
        self.total = int(options["total"]) if "total" in options else None
        self.step = self.limit * int(options.get("pages", 1))
        rate = float(options.get("per_second", 0))
        self.gap = int(options.get("slots", 1)) / rate if rate else 0.0

    def partitions(self):
        if self.total is None:
            return [PageRange(0, None)]
        return [PageRange(at, min(self.total, at + self.step)) for at in range(0, self.total, self.step)] or [PageRange(0, 0)]

    def read(self, partition: PageRange):
        offset, asked = partition.offset, 0.0
        while partition.end is None or offset < partition.end:
            if (early := asked + self.gap - time.monotonic()) > 0 and asked:
                time.sleep(early)
            asked = time.monotonic()
            rows = _asked(self.options, offset, self.limit)
            if partition.end is not None:
                rows = rows[: partition.end - offset]
            for i, row in enumerate(rows):
                yield offset + i, json.dumps(row, sort_keys=True)
            offset += self.limit
            if partition.end is None and len(rows) < self.limit:
                return


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marlstream_paged"

    def schema(self) -> str:
        return "pos long, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def length_of(spark: SparkSession, options: dict) -> int:
    """How many rows a service has."""

    def has_row(batches):
        for batch in batches:
            batch["found"] = [len(_asked(options, int(at), 1)) > 0 for at in batch["at"]]
            yield batch

    def probed(places: list[int]) -> dict[int, bool]:
        asked = spark.createDataFrame([(p,) for p in places], "at long").repartition(len(places))
        return {r["at"]: r.found for r in asked.mapInPandas(has_row, "at long, found boolean").collect()}

    found = probed([0, *(2**k for k in range(FARTHEST + 1))])
    # a row is at `low`, none at `high`
    low, high = max((p for p, has in found.items() if has), default=-1), min((p for p, has in found.items() if not has), default=None)
    if high is None:
        raise ValueError(f"the service has more than 2 ** {FARTHEST} rows")
    while high - low > 1:
        inner = sorted({low + (high - low) * i // (PROBES + 1) for i in range(1, PROBES + 1)} - {low, high}) or [low + 1]
        found = probed(inner)
        low, high = max([low, *(p for p, has in found.items() if has)]), min([high, *(p for p, has in found.items() if not has)])
    return high


def paged_rows(spark: SparkSession, options: dict) -> DataFrame:
    """(pos, row) of a paged service whose length isn't known, read by as many tasks as it has ranges of pages."""
    spark.dataSource.register(PagedSource)
    asked = {k: str(v) for k, v in options.items()}
    return spark.read.format("marlstream_paged").options(**asked).option("total", length_of(spark, asked)).load()
