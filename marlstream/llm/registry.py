"""Collects the queries of this subpackage, and the pipeline's."""

from __future__ import annotations

import functools
import importlib

from marlstream.session import ship

MODULES = ("url_rules", "tool_chat", "language", "pieces", "near_copies", "line_copies", "leaks", "word_repeats", "suffix_repeats", "media", "resampling", "spelling", "quality")


def _modules():
    return [importlib.import_module(f"marlstream.llm.{name}") for name in MODULES]


def shipped(f):
    """A query or stage whose executors are given this package first."""

    @functools.wraps(f)
    def run(spark, *rest):
        ship(spark)
        return f(spark, *rest)

    return run


def queries() -> dict:
    found = {}
    for module in _modules():
        found |= {name: shipped(f) for name, f in module.QUERIES.items()}
    import corpus_pipeline

    found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict:
    found = {}
    for module in _modules():
        found |= getattr(module, "ORACLE", {})
    import corpus_pipeline

    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
