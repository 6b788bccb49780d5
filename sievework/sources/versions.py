"""Versioned parquet tables: immutable version folders and one manifest for each, read through Hadoop's file system.

<root>/<table>/v<N>/ holds data, <root>/<table>/manifests/v<N>.json its parent, operation, rows and properties.
Reading a version that isn't there raises; nothing falls back to the latest one.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Catalog:
    def __init__(self, spark: SparkSession, root: str, namespace: str = "ops"):
        self.spark, self.root, self.namespace = spark, root.rstrip("/"), namespace

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _list(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def _read_text(self, path: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text(path, wholetext=True).collect())

    def _write_text(self, path: str, text: str) -> None:
        fs, p = self._fs(path)
        out = fs.create(p, False)  # a version is published once
        out.write(bytearray(text.encode()))
        out.close()

    def guard(self, table: str) -> None:
        """Maintenance touches plain names of this namespace only."""
        if not table.isidentifier():
            raise ValueError(f"{self.namespace}.{table} is not a table of {self.namespace}")

    # versions

    def versions(self, table: str) -> list[int]:
        return sorted(int(n[1:-5]) for n in self._list(f"{self.root}/{table}/manifests") if n.endswith(".json"))

    def manifest(self, table: str, version: int | None = None) -> dict:
        known = self.versions(table)
        version = known[-1] if version is None and known else version
        if version not in known:
            raise LookupError(f"{table} has no version {version}")
        return json.loads(self._read_text(f"{self.root}/{table}/manifests/v{version}.json"))

    def read(self, table: str, version: int | None = None) -> DataFrame:
        m = self.manifest(table, version)
        return self.spark.read.option("basePath", f"{self.root}/{table}/v{m['version']}").parquet(f"{self.root}/{table}/v{m['version']}")

    def publish(self, df: DataFrame, table: str, operation: str, partition_by: tuple[str, ...] = (), properties: dict | None = None) -> dict:
        """A whole new version; the old ones stay."""
        self.guard(table)
        known = self.versions(table)
        parent = known[-1] if known else None
        version = (parent or 0) + 1
        path = f"{self.root}/{table}/v{version}"
        began = time.time()
        df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
        old = self.manifest(table, parent)["properties"] if parent else {}
        m = {"version": version, "parent": parent, "operation": operation, "rows": self.spark.read.parquet(path).count(), "partition_by": list(partition_by), "wall_s": round(time.time() - began, 3), "properties": old | (properties or {})}
        self._write_text(f"{self.root}/{table}/manifests/v{version}.json", json.dumps(m))
        return m

    def files(self, table: str, version: int | None = None) -> DataFrame:
        """path, bytes and rows of each data file."""
        df = self.read(table, version)
        return df.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count(F.lit(1)).alias("rows"))

    def history(self, table: str) -> DataFrame:
        rows = [self.manifest(table, v) for v in self.versions(table)]
        return self.spark.createDataFrame([(m["version"], m["parent"], m["operation"], m["rows"], m["wall_s"]) for m in rows], "version int, parent int, operation string, rows long, wall_s double")

    def expire(self, table: str, retain_last: int, protected: tuple[int, ...] = ()) -> list[int]:
        """Delete old versions but the last ones and the protected ones."""
        self.guard(table)
        gone = [v for v in self.versions(table)[: -max(1, retain_last)] if v not in protected]
        for v in gone:
            for path in (f"{self.root}/{table}/manifests/v{v}.json", f"{self.root}/{table}/v{v}"):
                fs, p = self._fs(path)
                fs.delete(p, True)
        return gone

    def drop(self, table: str) -> None:
        self.guard(table)
        fs, p = self._fs(f"{self.root}/{table}")
        fs.delete(p, True)
