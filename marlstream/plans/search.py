"""Paged search over metadata tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstream.operators import paging
from marlstream.plans.catalog import register, table


@register(
    "search_paged",
    """
    SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a')
    ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40
    """,
)
def search_paged(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return paging.page(part.where(paging.matches("p_name", "a")), ["p_name", "p_partkey"], offset=40, limit=20)


@register(
    "search_paged_count",
    "SELECT count(*) AS total_count FROM part WHERE contains(lower(p_name), 'a')",
)
def search_paged_count(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_name")
    return part.where(paging.matches("p_name", "a")).agg(F.count("*").alias("total_count"))
