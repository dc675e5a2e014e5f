"""Session factory and the few settings the operators rely on."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int = 8, shuffle_partitions: int = 8, memory: str = "12g", app: str = "marlstream") -> SparkSession:
    """A session for tests and benchmarks; on a cluster, pass your own session to the operators."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once for each application, by Spark's own file distribution. The archive
    stays on the driver, which serves it to executors that start later."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-"), "marlstream-package.zip")
    atexit.register(shutil.rmtree, archive.parent, ignore_errors=True)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)


@functools.cache
def _folder_of_tests() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, a local master gets a folder in /tmp;
    any other is refused, as its executors couldn't read each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _folder_of_tests()
    return found.rstrip("/")


_stored_at: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder and its path; PySpark has no call of its own that deletes files."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame) -> DataFrame:
    """Writes a frame as Parquet to the shared folder and reads it back: what reads it twice gets the same rows in the
    same tasks' order, and a lost executor costs a re-read. What isn't `dropped` before goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/marlstream-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, own = file_system(spark, path)
    fs.deleteOnExit(own)
    found = spark.read.schema(df.schema).parquet(path)
    _stored_at[found] = path
    return found


def dropped(*frames: DataFrame) -> None:
    """Deletes the files of stored frames. Only for frames that nothing reads any more: what was made from them must have
    been stored itself."""
    for df in frames:
        if (path := _stored_at.pop(df, None)) is not None:
            fs, own = file_system(df.sparkSession, path)
            fs.delete(own, True)
            fs.cancelDeleteOnExit(own)
