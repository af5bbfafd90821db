"""A table of Parquet folders under numbered manifests: merges replace touched partitions only, and a batch counts once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    """``root`` holds data folders and ``manifest/<version>.json``. The highest manifest is the table.

    A manifest names the folder of each partition and, per writer, the last batch that it took, so a batch that comes
    again after a crash changes nothing. A version is taken by creating its manifest, which fails if it exists; readers
    of an older version keep their files. The manifest is as long as there are partitions.
    """

    def __init__(self, spark: SparkSession, root: str, schema: str, partition: Column | None = None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.partition = (F.lit("all") if partition is None else partition).cast("string")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        top = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(top)] if self._fs.exists(top) else []
        versions = sorted(n for n in names if n.endswith(".json"))
        if not versions:
            return {"version": 0, "parts": {}, "batches": {}}
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.root}/manifest/{versions[-1]}", 1).values().first())

    def read(self, parts: list[str] | None = None) -> DataFrame:
        live = self.manifest()["parts"]
        folders = [f for p, f in sorted(live.items()) if parts is None or p in parts]
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, combine: Callable[[DataFrame, DataFrame], DataFrame], writer: str, batch: int) -> bool:
        """Replace the partitions that ``incoming`` touches by ``combine(stored rows of these, incoming)``; False if taken before."""
        old = self.manifest()
        if old["batches"].get(writer, -1) >= batch:
            return False
        touched = [r[0] for r in incoming.select(self.partition).distinct().collect()]
        parts = dict(old["parts"])
        if touched:
            folder = f"data/{old['version'] + 1:08d}-{uuid.uuid4().hex}"
            out = combine(self.read(touched), incoming)
            out.withColumn("_part", self.partition).write.partitionBy("_part").parquet(f"{self.root}/{folder}")
            for p in touched:
                parts.pop(p, None)
            for s in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
                name = s.getPath().getName()
                if name.startswith("_part="):
                    parts[name.removeprefix("_part=")] = f"{folder}/{name}"
        self._commit({"version": old["version"] + 1, "parts": parts, "batches": old["batches"] | {writer: batch}})
        return True

    def _commit(self, manifest: dict) -> None:
        out = self._fs.create(self._path(f"{self.root}/manifest/{manifest['version']:08d}.json"), False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
