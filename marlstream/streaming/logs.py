"""Log tail and event windows with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstream.sources.files import log_rows


def tail(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Log rows as their files appear. The checkpoint remembers what was read, so a restart goes on where it was; lines are
    never cut, as files are whole."""
    lines = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return log_rows(lines)


def level_counts(rows: DataFrame, time: str = "timestamp", window: str = "1 minute", delay: str = "10 minutes") -> DataFrame:
    """Rows by level and event-time window; what comes later than the delay is left out."""
    moment = rows.withColumn("__at", F.col(time).try_cast("timestamp")).where("__at IS NOT NULL").withWatermark("__at", delay)
    return moment.groupBy(F.window("__at", window), "level").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "level", "n")


def append_to(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Copies tailed rows to another log. A batch that is repeated after a failure replaces its own folder, so that no
    row is written twice."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/batch={number}")

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def tail_bytes(spark: SparkSession, path: str | None = None, control: str | None = None) -> DataFrame:
    """Log rows (level, message, timestamp) of a file that grows, as lines are appended; `control` names a file that holds
    the path of the log, which may change while the stream runs. Lines that aren't JSON are left out."""
    from marlstream.streaming.tailed import TailSource

    spark.dataSource.register(TailSource)
    reader = spark.readStream.format("marlstream_tail")
    lines = (reader.option("path", path) if path is not None else reader.option("control", control)).load()
    return log_rows(lines.select(F.col("line").alias("value")))


def merged_into(rows: DataFrame, path: str, checkpoint: str, keys: list[str], available_now: bool = False) -> StreamingQuery:
    """Keeps a keyed table of the latest row of each key (`sources.keyed`). A batch writes only the buckets it touches, and
    one that is repeated after a failure is known to be in."""
    from marlstream.sources.keyed import KeyedTable

    def put(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, path, keys, latest="timestamp")
        table.upsert(batch, writer=checkpoint, batch=number)
        table.compact()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def once_into(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Merges logs into one that has each line (level, message, timestamp) once, however many logs bring it, however late and
    after however many restarts: a line's hash is its key in a keyed table (`sources.keyed`), which isn't read for it. A double
    costs a row of a delta until the next compaction. `read_once` gives the lines."""
    from marlstream.sources.keyed import KeyedTable

    line = ["level", "message", "timestamp"]

    def put(batch: DataFrame, number: int) -> None:
        table = KeyedTable(batch.sparkSession, path, ["k1", "k2"])
        table.upsert(batch.select(*line, F.xxhash64(*line).alias("k1"), F.xxhash64(F.lit(7), *line).alias("k2")), writer=checkpoint, batch=number)
        table.compact()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_once(spark: SparkSession, path: str) -> DataFrame:
    from marlstream.sources.keyed import KeyedTable

    return KeyedTable(spark, path, ["k1", "k2"]).read().drop("k1", "k2")
