"""Connected components by alternating large-star and small-star operations on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstream.llm.common import dropped, written

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One operation. Each node's smallest neighbour is found by a pre-aggregated group-by and joined back, so a node
    with many edges is never gathered anywhere; the minima are written first so that Spark can split a skewed join."""
    if large:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = written(around.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    joined = around.join(least, "u")
    if large:
        found = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        found = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    after = written(found.where(F.col("u") != F.col("v")).distinct())
    dropped(least, edges)
    return after


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u, v): the component is its smallest node. Nodes are integers."""
    now = written(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = _star(_star(now, True), False)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
