"""Tables on shared storage: snapshots that are written whole, and logs that grow."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Spark's setting that removes a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only, as executors don't share those."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        known = f"file://{tempfile.mkdtemp(prefix='marquee-')}"
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


_WRITTEN: list[str] = []


def stored(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written once to the shared folder and read back, which ends its lineage; the shuffle files that it took go at once.
    ``discard`` or ``drop_stored`` removes such tables."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a folder on any file system that Spark knows; False if it wasn't there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True))


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``stored`` that no open result reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            known = next((p for p in _WRITTEN if p.rsplit("/", 1)[1] == folder.rsplit("/", 1)[1]), None)
            if known:
                _WRITTEN.remove(known)
                remove(df.sparkSession, known)


def drop_stored(spark: SparkSession) -> int:
    """Remove the tables that ``stored`` wrote in this process, once no result that needs them is open; returns how many."""
    n = 0
    while _WRITTEN:
        n += remove(spark, _WRITTEN.pop())
    return n


def write_index_tables(tables: dict[str, DataFrame], base: str, version: str) -> dict[str, str]:
    """Each table as a new Parquet snapshot ``base/name/version``; scan audits (source_scans) are appended instead. Readers take the
    returned paths, so an overwrite is a change of version and never touches files in use."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{base}/{name}" if name == "source_scans" else f"{base}/{name}/{version}"
        df.write.mode("append" if name == "source_scans" else "error").parquet(paths[name])
    return paths
