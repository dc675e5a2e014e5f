"""Paged services and fetched assets under failures."""

from __future__ import annotations

import json

import pytest

from marlstream.sources import fetched, paged

PROVIDER = """
import pathlib

def provide(options, offset, limit):
    total, folder = int(options["rows"]), options.get("folder")
    if folder:
        seen = pathlib.Path(folder, f"{offset}-{limit}")
        if (offset // limit) % 7 == 3 and not seen.exists():
            seen.touch()
            raise ConnectionError("not yet")
    return [{"n": i} for i in range(offset, min(total, offset + limit))]
"""


@pytest.fixture(scope="module")
def provider(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("service") / "flaky_service_for_tests.py"
    path.write_text(PROVIDER)
    spark.sparkContext.addPyFile(str(path))
    spark.dataSource.register(paged.PagedSource)
    return "flaky_service_for_tests:provide"


@pytest.mark.parametrize("rows", [0, 1, 2, 99, 100, 4097, 25_000])
def test_length(spark, provider, rows):
    assert paged.length_of(spark, {"provider": provider, "rows": str(rows)}) == rows


def test_unknown_length_with_failures(spark, provider, tmp_path):
    options = {"provider": provider, "rows": 25_000, "folder": str(tmp_path), "attempts": 3, "wait": 0.01, "pages": 25}
    found = paged.paged_rows(spark, options)
    assert found.rdd.getNumPartitions() == 10
    rows = sorted((r.pos, json.loads(r.row)["n"]) for r in found.collect())
    assert rows == [(i, i) for i in range(25_000)] and any(tmp_path.iterdir())
    with pytest.raises(Exception, match="not yet"):
        paged.paged_rows(spark, options | {"attempts": 1, "folder": str(tmp_path.parent)}).collect()


def test_rate(provider):
    import sys
    import time
    import types

    module = types.ModuleType("quick_service_for_tests")
    module.provide = lambda options, offset, limit: [1] * limit
    sys.modules[module.__name__] = module
    reader = paged.PagedReader({"provider": f"{module.__name__}:provide", "total": "60", "limit": "10", "pages": "6", "per_second": "40", "slots": "2"})
    began = time.monotonic()
    assert len(list(reader.read(reader.partitions()[0]))) == 60
    assert time.monotonic() - began >= 5 * 0.05


def test_fetched(spark, tmp_path):
    folder = str(tmp_path)

    def get(url):
        import pathlib
        import time
        import uuid

        own = pathlib.Path(folder, f"open-{uuid.uuid4().hex}")
        own.touch()
        n = len(list(pathlib.Path(folder).glob("open-*")))
        pathlib.Path(folder, f"most-{n}").touch()
        time.sleep(0.02)
        own.unlink()
        seen = pathlib.Path(folder, f"seen-{url}")
        if int(url) % 10 == 3 or int(url) % 10 == 4 and not seen.exists():
            seen.touch()
            raise OSError(f"refused {url}")
        return url.encode() * 2

    assets = spark.range(80).selectExpr("id AS uid", "CASE WHEN id <> 79 THEN CAST(id AS string) END AS url")
    found = fetched.fetched(assets, get, at_once=6, tasks=3, wait=0.01)
    good = {r.uid: (r.content, r.attempts) for r in fetched.assets_of(found).collect()}
    dead = {r.uid: (r.error, r.attempts) for r in fetched.dead_letters(found).collect()}
    assert dead == {i: (f"OSError: refused {i}", 2) for i in range(3, 79, 10)} | {79: ("no address", 0)}
    assert good == {i: (str(i).encode() * 2, 2 if i % 10 == 4 else 1) for i in range(79) if i % 10 != 3}
    most = max(int(p.name.removeprefix("most-")) for p in tmp_path.glob("most-*"))
    assert 1 < most <= 6
