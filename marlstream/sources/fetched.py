"""Fetches binaries by address, few at a time, with failures as rows.

    found = fetched(assets, get)                # stored
    sinks: assets_of(found), dead_letters(found)

`at_once` bounds the requests that are open in the whole application, whatever its executors: the rows are dealt to a
fixed number of tasks and each has its share of the connections. A row that fails is tried again; what fails in all
attempts is a row with its error. The result is stored, so that reading it twice doesn't fetch twice. A task that is run
again after a loss fetches its rows again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstream.session import stored

AT_ONCE = 10
ATTEMPTS = 2


def _tried(get: Callable[[str], bytes], url: str, attempts: int, wait: float) -> tuple[bytes | None, int, str | None]:
    for n in range(1, attempts + 1):
        try:
            return get(url), n, None
        except Exception as e:  # noqa: BLE001  whatever the client raises
            error = f"{type(e).__name__}: {e}"
            if n < attempts:
                time.sleep(wait)
    return None, attempts, error


def fetched(assets: DataFrame, get: Callable[[str], bytes], key: str = "uid", url: str = "url", at_once: int = AT_ONCE, tasks: int | None = None, attempts: int = ATTEMPTS, wait: float = 1.0) -> DataFrame:
    """(key, url, content, attempts, error) of each row; content or error is null. A null url is an error without an attempt.
    `tasks` of `at_once` connections share the work, each with the same number; by default five."""
    tasks = max(1, min(tasks or 5, at_once))
    threads = at_once // tasks

    def run(batches):
        with ThreadPoolExecutor(threads) as pool:
            waiting: deque = deque()

            def row():
                k, address, future = waiting.popleft()
                content, n, error = future.result() if future else (None, 0, "no address")
                return pa.RecordBatch.from_pydict({"key": pa.array([k], pa.string()), "url": pa.array([address], pa.string()), "content": pa.array([content], pa.binary()), "attempts": pa.array([n], pa.int32()), "error": pa.array([error], pa.string())})

            for batch in batches:
                for k, address in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    # contents that nobody has taken yet are as few as the connections
                    if len(waiting) >= threads:
                        yield row()
                    waiting.append((k, address, pool.submit(_tried, get, address, attempts, wait) if address is not None else None))
            while waiting:
                yield row()

    asked = assets.select(F.col(f"`{key}`").cast("string"), F.col(f"`{url}`").cast("string")).repartition(tasks)
    found = asked.mapInArrow(run, "key string, url string, content binary, attempts int, error string")
    return stored(found.select(F.col("key").cast(assets.schema[key].dataType).alias(key), F.col("url").alias(url), "content", "attempts", "error"))


def assets_of(found: DataFrame) -> DataFrame:
    return found.where("error IS NULL").drop("error")


def dead_letters(found: DataFrame) -> DataFrame:
    return found.where("error IS NOT NULL").drop("content")
