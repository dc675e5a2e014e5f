"""Writers: entries by type and locale, chunked JSON, keyed upserts, manifests, logs."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstream.operators import lookup, merge, windows
from marlstream.session import file_system

CHUNK_BYTES, CHUNK_ROWS = 1 << 20, 100


def entries(df: DataFrame, path: str, by: tuple[str, ...] = ("content_type", "locale"), mode: str = "overwrite", rows_per_file: int = 0) -> None:
    """JSON lines in a folder for each type and locale. A large group is spread over the tasks that hold it."""
    writer = df.write.mode(mode).partitionBy(*by)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).json(path)


def manifest(df: DataFrame, by: tuple[str, ...] = ("content_type", "locale")) -> DataFrame:
    """What `entries` writes: a row for each folder, with its path and number of rows."""
    folder = F.concat_ws("/", *[F.concat(F.lit(f"{c}="), F.col(c)) for c in by])
    return df.groupBy(*by).agg(F.count("*").alias("n_rows")).withColumn("folder", folder)


def chunked(df: DataFrame, path: str, order: list[str], by_bytes: bool = True) -> None:
    """JSON lines in chunks of about CHUNK_BYTES, or of CHUNK_ROWS rows, a folder each, in a total order."""
    if by_bytes:
        cut = windows.chunks_by_bytes(df, order, F.octet_length(F.to_json(F.struct(*df.columns))), CHUNK_BYTES)
    else:
        cut = windows.chunks_by_count(df, order, CHUNK_ROWS)
    cut.repartition("chunk").sortWithinPartitions("chunk", *order).write.mode("overwrite").partitionBy("chunk").json(path)


def upsert(df: DataFrame, path: str, keys: list[str]) -> None:
    """Puts rows into a Parquet table, which may not be there yet: those of known keys replace the old ones. The merged table
    is written beside the old one, which is replaced by renaming when all is written and deleted last; so at any moment one
    whole table is there, at `path` or, if the driver is lost between the two renames, at `path.old`, from which the next
    upsert goes on."""
    spark = df.sparkSession
    fs, own = file_system(spark, path)
    _, new = file_system(spark, f"{path}.new")
    _, old = file_system(spark, f"{path}.old")
    if fs.exists(old):
        if fs.exists(own):
            fs.delete(old, True)
        else:
            fs.rename(old, own)
    known = fs.exists(own)
    rows = merge.upsert(spark.read.parquet(path), df, keys) if known else df
    rows.write.mode("overwrite").parquet(f"{path}.new")
    if known:
        fs.rename(own, old)
    fs.rename(new, own)
    fs.delete(old, True)


def replicated(df: DataFrame, path: str, locales: list[str]) -> None:
    """The master locale's rows in every other locale's folder."""
    entries(lookup.replicated(df.drop("locale"), locales), path, mode="append")


def log(df: DataFrame, path: str) -> None:
    """Appends (level, message, timestamp) as JSON lines, in new files that a tail picks up whole."""
    df.select("level", "message", "timestamp").write.mode("append").json(path)


def pushed(df: DataFrame, send: Callable[[list[str]], None], rows: int = 100, attempts: int = 3, wait: float = 2.0) -> DataFrame:
    """Hands the rows as JSON texts to `send`, `rows` at a time, in the tasks that hold them. A batch that raises is tried
    again after `wait` seconds, then twice as many, up to `attempts` times. Returns (row, attempts, error) of every row; what
    was never taken has an error and is for a dead-letter sink. A task that is run again sends its rows again, so the other
    side must take a row twice without harm."""
    names = [F.col(f"`{c}`") for c in df.columns]

    def run(batches):
        for batch in batches:
            texts = batch["row"].tolist()
            for at in range(0, len(texts), rows):
                part, error = texts[at : at + rows], None
                for n in range(1, attempts + 1):
                    try:
                        send(part)
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001  whatever the other side's client raises
                        error = f"{type(e).__name__}: {e}"
                        if n < attempts:
                            time.sleep(wait * 2 ** (n - 1))
                yield pd.DataFrame({"row": part, "attempts": n, "error": [error] * len(part)})

    return df.select(F.to_json(F.struct(*names)).alias("row")).mapInPandas(run, "row string, attempts int, error string")
