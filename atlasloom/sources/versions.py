"""Versioned tables on a file store: immutable versions, a manifest each, revert without copying, retention.

A version is a manifest that names data folders. It is written through Spark as one small JSON file whose appearance
commits the version; data folders that no manifest names are leftovers of failed jobs.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version int, kind string, reverted_to int, data array<string>, created_at timestamp, n_rows bigint, id_mark bigint"


class VersionStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs()
        if not fs.exists(p):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[1:]) for n in found if n.startswith("v") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}/_SUCCESS")))

    def latest(self) -> int | None:
        return (self.versions() or [None])[-1]

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        row = self.spark.read.text(f"{self.path}/manifests/v{version}").first()
        return json.loads(row.value)

    def _write(self, record: dict) -> int:
        line = self.spark.range(1).select(F.lit(json.dumps(record, sort_keys=True)).alias("value"))
        line.coalesce(1).write.mode("error").text(f"{self.path}/manifests/v{record['version']}")
        return record["version"]

    def commit(self, rows: DataFrame, kind: str = "update", add: bool = False, id_mark: int = 0) -> int:
        """Writes rows as the next version; `add` keeps the folders of the version before and adds these."""
        last = self.latest()
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{folder}")
        old = self.manifest(last) if last is not None else {"data": [], "id_mark": 0}
        n = self.spark.read.parquet(f"{self.path}/{folder}").count()
        return self._write({"version": (last or 0) + 1, "kind": kind, "reverted_to": None, "data": [*(old["data"] if add else []), folder], "n_rows": n + (old.get("n_rows", 0) if add else 0), "id_mark": max(old["id_mark"], id_mark)})

    def revert(self, to: int) -> int:
        """The next version is an earlier one again: the same folders, no data copied; ids given since are never given again."""
        last, target = self.latest(), self.manifest(to)
        return self._write({**target, "version": last + 1, "kind": "revert", "reverted_to": to, "id_mark": self.manifest(last)["id_mark"]})

    def read(self, version: int | None = None) -> DataFrame:
        data = self.manifest(version)["data"]
        return self.spark.read.option("mergeSchema", "true").parquet(*[f"{self.path}/{d}" for d in data])

    def difference(self, a: int, b: int, keys: list[str]) -> DataFrame:
        """Rows of version a whose keys version b lacks."""
        return self.read(a).join(self.read(b).select(*keys), keys, "left_anti")

    def prune(self, newest: int = 20, held: tuple[int, ...] = ()) -> list[int]:
        """Drops all but the newest and the held versions, and data that no version left names."""
        every = self.versions()
        keep = {*every[-newest:], *held}
        used = {d for v in keep for d in self.manifest(v)["data"]}
        fs, _ = self._fs()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        gone = [v for v in every if v not in keep]
        for v in gone:
            unused = [d for d in self.manifest(v)["data"] if d not in used]
            fs.delete(path(f"{self.path}/manifests/v{v}"), True)
            for d in unused:
                fs.delete(path(f"{self.path}/{d}"), True)
        return gone
