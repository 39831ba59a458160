"""Tables as a log of immutable segments.

A commit writes the rows of changed files as a new segment of each table, together with the keys
of these files, and becomes visible by one small log entry whose creation is atomic: two writers
of one version can't both succeed. Reading takes each segment without the files that later
commits changed, so a commit costs what changed and not what there is. `compact` writes one
segment again. Readers keep what they have resolved: segments are never altered.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["source_id", "rel_path"]
FORMAT = 1


class Conflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    def __init__(self, spark: SparkSession, home: str, most_broadcast: int = 500_000):
        self.spark, self.home, self.most_broadcast = spark, home.rstrip("/"), most_broadcast
        self._jvm = spark.sparkContext._jvm
        self._log = self._path(f"{self.home}/log")
        self._fs = self._log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(name)

    def log(self) -> list[dict]:
        """All log entries, oldest first."""
        if not self._fs.exists(self._log):
            return []
        names = sorted(x.getPath().getName() for x in self._fs.listStatus(self._log) if x.getPath().getName().endswith(".json"))
        out = []
        for name in names:
            stream = self._fs.open(self._path(f"{self.home}/log/{name}"))
            try:
                out.append(json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()))
            finally:
                stream.close()
        if any(x["format"] != FORMAT for x in out):
            raise ValueError("the store has another format")
        return out

    def version(self) -> int:
        return max((x["version"] for x in self.log()), default=0)

    def settings(self) -> dict:
        """What commits have set, later ones first."""
        return reduce(lambda a, b: a | b["settings"], self.log(), {})

    def _enter(self, entry: dict) -> None:
        path = self._path(f"{self.home}/log/{entry['version']:012d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as found:
            raise Conflict(str(found)) from found
        try:
            stream.write(bytearray(json.dumps(entry).encode()))
        finally:
            stream.close()

    def commit(self, changed: DataFrame | None = None, tables: dict[str, DataFrame] | None = None, settings: dict | None = None) -> int:
        """A new version: the files of `changed` (source_id, rel_path) have, in all tables, the rows given here and no others."""
        version = self.version() + 1
        entry = {"format": FORMAT, "version": version, "settings": settings or {}, "tables": {}, "keys": None, "changed": 0}
        base = f"{self.home}/v={version}"
        if changed is not None:
            changed.select(*KEY).distinct().write.mode("overwrite").parquet(f"{base}/keys")
            entry |= {"keys": f"{base}/keys", "changed": self.spark.read.parquet(f"{base}/keys").count()}
        for name, df in (tables or {}).items():
            self._write(df, f"{base}/{name}")
            entry["tables"][name] = f"{base}/{name}"
        self._enter(entry)
        return version

    def _write(self, df: DataFrame, path: str) -> None:
        """Rows in ranges of source, term, path and chunk. They are written once before, as finding the ranges would work them out twice."""
        ordered = [c for c in ("term", "rel_path", "chunk_index") if c in df.columns]
        raw = f"{path}.raw"
        df.write.mode("overwrite").parquet(raw)
        rows = self.spark.read.schema(df.schema).parquet(raw)
        rows.repartitionByRange("source_id", *ordered).sortWithinPartitions("source_id", *ordered).write.mode("overwrite").partitionBy("source_id").parquet(path)
        self._fs.delete(self._path(raw), True)

    def read(self, name: str) -> DataFrame | None:
        """A table as it is now; None if nothing was ever written to it."""
        log = self.log()
        start = max((i for i, x in enumerate(log) if x.get("compacted")), default=0)
        parts = []
        for i, x in enumerate(log):
            if i < start or name not in x["tables"]:
                continue
            df = self._segment(x["tables"][name])
            if df is None:
                continue
            later = [y for y in log[i + 1 :] if y["keys"] and not y.get("compacted")]
            if later:
                keys = self.spark.read.parquet(*[y["keys"] for y in later]).distinct()
                small = sum(y["changed"] for y in later) <= self.most_broadcast
                df = df.join(F.broadcast(keys) if small else keys, KEY, "left_anti")
            parts.append(df)
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None

    def _segment(self, path: str) -> DataFrame | None:
        if not any(x.isDirectory() for x in self._fs.listStatus(self._path(path))):
            return None  # no rows
        df = self.spark.read.option("basePath", path).parquet(path)
        return df.withColumn("source_id", F.col("source_id").cast("string"))

    def compact(self) -> int:
        """All tables in one segment each."""
        version = self.version() + 1
        entry = {"format": FORMAT, "version": version, "settings": {}, "tables": {}, "keys": None, "changed": 0, "compacted": True}
        for name in sorted({n for x in self.log() for n in x["tables"]}):
            df = self.read(name)
            if df is not None:
                path = f"{self.home}/v={version}/{name}"
                self._write(df, path)
                entry["tables"][name] = path
        self._enter(entry)
        return version
