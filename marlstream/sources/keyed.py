"""A Parquet table with keys whose upserts write only what changes.

Rows are dealt to buckets by a hash of their keys. An upsert writes its rows as a delta, a folder for each bucket it touches,
and then a manifest: which folders make up each bucket. A manifest is written under another name and put in place by one
rename, so a reader or the next writer sees the whole upsert or nothing of it; what a lost writer left behind belongs to no
manifest and goes with `vacuum`. Reading merges by key only those buckets that have more than one folder. `compact` gives
such buckets one folder again. Older versions stay readable until `vacuum`, and `reset` puts keys back to one of them.

Defined cases: of rows of one batch with equal keys the one with the largest `order` stays (of ties, that of the larger hash
of all columns); a null is a key like any other; an empty batch makes a version without folders; columns that the table lacks
are left out and missing ones are an error. One writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marlstream.session import file_system

BUCKETS = 64
#: folders of a bucket from which it is compacted
MOST_DELTAS = 8
_VERSION, _GONE, _BUCKET = "__version", "__gone", "__bucket"


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS, latest: str | None = None):
        """With `latest`, a column, the row with its largest value stays whatever the order of the upserts; such a table
        can't be reset."""
        self.spark, self.path, self.keys, self.buckets, self.latest = spark, path.rstrip("/"), list(keys), buckets, latest

    # --- manifests

    def versions(self) -> list[int]:
        fs, folder = file_system(self.spark, f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict | None:
        """{version, schema, keys, buckets: {bucket: [folder]}, written: {writer: batch}} of a version, or the newest."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else None
        if version is None:
            return None
        if version not in known:
            raise ValueError(f"version {version} isn't there any more, or not yet")
        fs, path = file_system(self.spark, f"{self.path}/manifests/{version:012d}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, found: dict) -> int:
        fs, new = file_system(self.spark, f"{self.path}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(new, True)
        stream.write(bytearray(json.dumps(found).encode()))
        stream.close()
        _, own = file_system(self.spark, f"{self.path}/manifests/{found['version']:012d}.json")
        if fs.exists(own) or not fs.rename(new, own):
            raise RuntimeError(f"another writer made version {found['version']}")
        return found["version"]

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """{bucket: folder} of rows (columns, __version, __gone)."""
        name = f"data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")
        rows.withColumn(_BUCKET, bucket).write.partitionBy(_BUCKET).parquet(f"{self.path}/{name}")
        fs, folder = file_system(self.spark, f"{self.path}/{name}")
        made = [x.getPath().getName() for x in fs.listStatus(folder)]
        return {n.partition("=")[2]: f"{name}/{n}" for n in made if n.startswith(f"{_BUCKET}=")}

    # --- writing

    def _put(self, rows: DataFrame, writer: str | None, batch: int) -> int:
        """rows (columns, __gone), a key once."""
        now = self.manifest() or {"version": 0, "schema": None, "keys": self.keys, "n": self.buckets, "buckets": {}, "written": {}}
        if now["keys"] != self.keys or now["n"] != self.buckets:
            raise ValueError(f"the table has keys {now['keys']} in {now['n']} buckets")
        if writer is not None and now["written"].get(writer, -1) >= batch:
            return now["version"]
        schema = rows.drop(_GONE).schema if now["schema"] is None else StructType.fromJson(now["schema"])
        version = now["version"] + 1
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema]
        added = self._write(rows.select(*columns, F.lit(version).cast("long").alias(_VERSION), F.col(_GONE)))
        buckets = {b: [*now["buckets"].get(b, []), *([added[b]] if b in added else [])] for b in {*now["buckets"], *added}}
        written = now["written"] | ({writer: batch} if writer is not None else {})
        return self._publish(now | {"version": version, "schema": schema.jsonValue(), "buckets": buckets, "written": written})

    def upsert(self, df: DataFrame, order: str | None = None, writer: str | None = None, batch: int = 0) -> int:
        """Puts rows in, those of known keys in place of the old ones; the new version. With a writer's name a batch that is
        already in, or one before it, is left out, so that a repeated batch changes nothing."""
        names, order = [F.col(f"`{c}`") for c in df.columns], order or self.latest
        rank = F.struct(*([F.col(f"`{order}`")] if order else []), F.xxhash64(*[F.to_json(F.struct(n)) for n in names]))
        once = df.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(F.max_by(F.struct(*names), rank).alias("__row"))
        return self._put(once.select("__row.*").withColumn(_GONE, F.lit(False)), writer, batch)

    def _of(self, rows: DataFrame, keys: DataFrame, how: str = "left_semi") -> DataFrame:
        """Rows whose keys are among those of another frame, or not; nulls are equal."""
        other = keys.select(*[F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(self.keys)]).distinct()
        same = [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(self.keys)]
        return rows.join(other, same, how)

    def delete(self, keys: DataFrame) -> int:
        return self._put(self._of(self.read(), keys).withColumn(_GONE, F.lit(True)), None, 0)

    def reset(self, keys: DataFrame, version: int) -> int:
        """Puts keys back to what they were in a version: the old row, or none."""
        if self.latest is not None:
            raise ValueError("a table of latest rows can't be reset")
        then = self._of(self.read(version), keys)
        gone = self._of(self._of(self.read(), keys), then, "left_anti")
        return self._put(then.withColumn(_GONE, F.lit(False)).unionByName(gone.withColumn(_GONE, F.lit(True))), None, 0)

    # --- reading

    def _folders(self, found: dict, folders: list[str]) -> DataFrame:
        schema = StructType.fromJson(found["schema"]).add(_VERSION, "long").add(_GONE, "boolean")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in folders]) if folders else self.spark.createDataFrame([], schema)

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The newest row of each key, deletions included."""
        names = [F.col(f"`{c}`") for c in rows.columns]
        newest = rows.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(F.max_by(F.struct(*names), F.struct(*([self.latest] if self.latest else []), _VERSION)).alias("__row"))
        return newest.select("__row.*")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, or of the newest."""
        found = self.manifest(version)
        if found is None:
            raise ValueError(f"{self.path} has no version yet")
        single = [f[0] for f in found["buckets"].values() if len(f) == 1]
        several = [x for f in found["buckets"].values() if len(f) > 1 for x in f]
        rows = self._folders(found, single)
        if several:
            rows = rows.unionByName(self._merged(self._folders(found, several)))
        return rows.where(~F.col(_GONE)).drop(_VERSION, _GONE)

    def history(self) -> DataFrame:
        """All rows that are kept, with the version that brought them and whether it took them away."""
        found = self.manifest()
        rows = self._folders(found, [x for f in found["buckets"].values() for x in f])
        return rows.withColumnRenamed(_VERSION, "version").withColumnRenamed(_GONE, "gone")

    # --- upkeep

    def compact(self, most: int = MOST_DELTAS) -> int:
        """Gives each bucket of `most` folders or more one folder; other buckets aren't touched. Rows keep their versions."""
        found = self.manifest()
        full = {b: f for b, f in found["buckets"].items() if len(f) >= max(2, most)}
        if not full:
            return found["version"]
        made = self._write(self._merged(self._folders(found, [x for f in full.values() for x in f])).where(~F.col(_GONE)))
        buckets = {b: [made[b]] if b in made else [] for b in full}
        return self._publish(found | {"version": found["version"] + 1, "buckets": {b: f for b, f in (found["buckets"] | buckets).items() if f}})

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all versions but the newest `keep`, and the folders that none of these has."""
        known = self.versions()
        used = {x for v in known[-keep:] for f in self.manifest(v)["buckets"].values() for x in f}
        for v in known[:-keep]:
            fs, path = file_system(self.spark, f"{self.path}/manifests/{v:012d}.json")
            fs.delete(path, False)
        fs, data = file_system(self.spark, f"{self.path}/data")
        for run in fs.listStatus(data) if fs.exists(data) else []:
            own = f"data/{run.getPath().getName()}"
            folders = [x.getPath() for x in fs.listStatus(run.getPath())]
            if not any(f"{own}/{x.getName()}" in used for x in folders):
                fs.delete(run.getPath(), True)
                continue
            for x in folders:
                if x.getName().startswith(f"{_BUCKET}=") and f"{own}/{x.getName()}" not in used:
                    fs.delete(x, True)
