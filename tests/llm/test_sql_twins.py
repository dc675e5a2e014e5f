"""Queries of this subpackage that SQL can express, against their SQL twins."""

from __future__ import annotations

import duckdb
import pytest

from marlstream.llm import registry

TABLES = ("documents", "pages", "labels", "conversations", "benchmark")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    wanted = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    found = registry.queries()[name](spark, sf_dir)
    assert sorted(found.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted.fetchall()))
