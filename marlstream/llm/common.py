"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstream.session import dropped, stored


__all__ = ["dropped", "lower_ascii", "of_ids", "table", "written"]
#: ids that may be broadcast, 16 MB of them
BROADCAST_IDS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """A frame written to the shared folder and read back, which cuts the lineage: a lost executor costs a re-read and not
    a recomputation, and a frame used twice is computed once."""
    return stored(df)


def lower_ascii(column):
    """Lower-cases A-Z only."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def of_ids(docs: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows of docs whose doc_id is among the distinct ids, a null id included, or with "left_anti" the others. Texts are
    moved for it only if there are more ids than may be broadcast."""
    ids = written(ids.select(F.col("doc_id").alias("__of_id")))
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, F.col("doc_id").eqNullSafe(F.col("__of_id")), how)
