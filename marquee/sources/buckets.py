"""Tables on shared storage that change bucket by bucket: a manifest names each bucket's files, and a change swaps the manifest."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from marquee.sources.tables import remove


class Conflict(RuntimeError):
    """Another writer has put a manifest under the same version."""


class BucketedTable:
    """Rows dealt to ``buckets`` by the hash of their ``key``.

    ``merge`` reads and writes only the buckets that its changes fall into, so what it writes follows the changes, not the table.
    Readers see one manifest's files; files of a version that never got its manifest are overwritten by the next try. The
    last ``keep`` versions stay readable. Choose ``buckets`` so that one bucket suits one task.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: StructType, buckets: int = 64, keep: int = 2):
        self.spark, self.path, self.key, self.buckets, self.keep = spark, path.rstrip("/"), list(key), buckets, max(2, keep)
        self.schema = schema

    # --- manifests ---------------------------------------------------------------------------------------------------
    def _file(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def versions(self) -> list[int]:
        """Versions that have a manifest, oldest first."""
        system, where = self._file("manifests")
        if not system.exists(where):
            return []
        names = [s.getPath().getName() for s in system.listStatus(where)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, or of the newest: version, batch, and per bucket its folder and number of rows."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "batch": None, "buckets": {}}
        system, where = self._file(f"manifests/{version:012d}.json")
        stream = system.open(where)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        system, part = self._file(f"manifests/{manifest['version']:012d}.part")
        _, where = self._file(f"manifests/{manifest['version']:012d}.json")
        stream = system.create(part, True)
        try:
            stream.write(json.dumps(manifest, sort_keys=True).encode())
        finally:
            stream.close()
        if system.exists(where) or not system.rename(part, where):
            raise Conflict(f"{self.path}: version {manifest['version']} is there already")

    def before(self, batch: int) -> dict:
        """The newest manifest that doesn't hold ``batch`` yet."""
        for version in reversed(self.versions()):
            found = self.manifest(version)
            if found["batch"] is None or found["batch"] < batch:
                return found
        return self.manifest(0)

    # --- rows --------------------------------------------------------------------------------------------------------
    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets that rows with these keys belong to; at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def read(self, buckets: Iterable[int] | None = None, manifest: dict | None = None) -> DataFrame:
        """The table, or some of its buckets, as of a manifest."""
        known = (manifest or self.manifest())["buckets"]
        wanted = known if buckets is None else [str(b) for b in buckets]
        folders = [f"{self.path}/{known[b]['folder']}" for b in wanted if b in known]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, apply: Callable[[DataFrame, DataFrame], DataFrame], batch: int | None = None) -> dict:
        """Replace the buckets of ``changes`` by ``apply(their rows, changes)``, which has to keep every row's key, and return the
        new manifest. A ``batch`` that the table holds already changes nothing."""
        now = self.manifest()
        if batch is not None and now["batch"] is not None and now["batch"] >= batch:
            return now
        touched, version = self.touched(changes), now["version"] + 1
        buckets = dict(now["buckets"])
        if touched:
            rows = apply(self.read(touched, now), changes).select(*self.schema.names).withColumn("_bucket", self.bucket())
            folder = f"data/v{version:012d}"
            # Adaptive execution splits a bucket that is too large for a task, and joins small ones.
            rows.hint("rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            for b in touched:
                buckets.pop(str(b), None)
            written = self._counts(f"{self.path}/{folder}")
            if not set(written) <= set(touched):
                raise ValueError("a merge has to keep the keys of its rows")
            buckets.update({str(b): {"folder": f"{folder}/_bucket={b}", "rows": n} for b, n in written.items()})
        self._put({"version": version, "batch": now["batch"] if batch is None else batch, "buckets": buckets})
        self._forget(version)
        return self.manifest(version)

    def _counts(self, path: str) -> dict[int, int]:
        schema = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        return {r["_bucket"]: r["count"] for r in self.spark.read.schema(schema).parquet(path).groupBy("_bucket").count().collect()}

    def _forget(self, version: int) -> None:
        """Remove manifests older than the last ``keep`` and the folders that only these name."""
        found = [self.manifest(v) for v in self.versions()]
        kept = {b["folder"] for m in found[-self.keep :] for b in m["buckets"].values()}
        for old in found[: -self.keep]:
            for folder in {b["folder"] for b in old["buckets"].values()} - kept:
                remove(self.spark, f"{self.path}/{folder}")
            remove(self.spark, f"{self.path}/manifests/{old['version']:012d}.json")
