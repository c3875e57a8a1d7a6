"""Structured Streaming twins of the index diff, the phase counts and the key archive."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructType

from marquee.operators.index import last_rows, missing_members, scan_diff_summary, scan_row_flags, upsert_stats
from marquee.sources.buckets import BucketedTable
from marquee.sources.files import KeyArchive
from marquee.sources.tables import discard, stored

FIELDS = ["title", "duration_seconds", "upload_date", "channel", "availability", "media_type"]
STATS = ["view_count", "like_count"]


#: Spark's setting for where streams keep their state.
STATE_STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MEMBER = ["source_id", "media_key"]
PHASES = ("preparing", "downloading", "processing", "converting")


def _run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, mode: str = "append", path: str | None = None) -> None:
    """Process all that is there, in micro-batches, and stop; a later call with the same checkpoint goes on from there."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").start(path)
    query.awaitTermination()


def index_tables(spark: SparkSession, base: str, like: DataFrame, buckets: int = 64) -> tuple[BucketedTable, BucketedTable]:
    """Media (fields and stats by media_key) and members (by source and key) below ``base``; ``like`` has the columns of scans."""
    media = like.select("media_key", *FIELDS, *STATS).schema
    members = like.selectExpr("source_id", "media_key", "position", "TRUE AS is_present", "0L AS last_seen").schema
    return BucketedTable(spark, f"{base}/media", ["media_key"], media, buckets), BucketedTable(spark, f"{base}/members", MEMBER, members, buckets)


def apply_scan(media: BucketedTable, members: BucketedTable, batch: DataFrame, number: int) -> DataFrame:
    """Bring one round of scans (with ``complete``) into the index; returns its audit rows, one per source.

    Media and members are rewritten in the buckets that the round touches. A round that runs again finds the rows from before
    it, gives the same audit rows and changes nothing.
    """
    scan = batch.drop("complete")
    complete = batch.groupBy("source_id").agg(F.bool_and("complete").alias("complete"))
    old = media.read(media.touched(scan), media.before(number))
    present = members.read(manifest=members.before(number)).filter("is_present").select(*MEMBER)
    gone = missing_members(present, scan, complete)
    audit = stored(scan_diff_summary(scan_row_flags(old, scan, FIELDS, STATS), gone))
    listed = scan.groupBy(*MEMBER).agg(F.max("position").alias("position")).withColumns({"is_present": F.lit(True), "last_seen": F.lit(number).cast("long")})
    left = gone.select(*MEMBER, F.lit(None).cast(dict(listed.dtypes)["position"]).alias("position"), F.lit(False).alias("is_present"), F.lit(None).cast("long").alias("last_seen"))
    changes = stored(listed.unionByName(left))

    def fields(rows: DataFrame, scan: DataFrame) -> DataFrame:
        newest = last_rows(scan.select("media_key", "source_id", "position", *FIELDS), ["media_key"], ["source_id", "position"]).drop("source_id", "position")
        kept = rows.select("media_key", *FIELDS).join(newest.select("media_key"), "media_key", "left_anti").unionByName(newest)
        return kept.join(upsert_stats(rows.select("media_key", *STATS), scan, STATS), "media_key", "left")

    def places(rows: DataFrame, changes: DataFrame) -> DataFrame:
        rest = ("position", "is_present", "last_seen")
        new = changes.select(*MEMBER, *[F.col(c).alias(f"_new_{c}") for c in rest])
        return rows.join(new, MEMBER, "full").select(*MEMBER, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])

    media.merge(scan, fields, number)
    members.merge(changes, places, number)
    discard(changes)
    return audit


def stream_index(scans: DataFrame, base: str, checkpoint: str, buckets: int = 64) -> None:
    """Index tables from a stream of scan rows (source_id, media_key, position, complete, fields, stats).

    A micro-batch is one round of scans, see ``apply_scan``: what it writes follows its own rows, and a batch that runs again changes
    nothing. Its audit rows stand below ``audits`` under the batch's number; ``index_tables`` gives the tables.
    """

    def apply(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        media, members = index_tables(batch.sparkSession, base, batch, buckets)
        apply_scan(media, members, batch, number).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{base}/audits/number={number}")
        batch.unpersist()

    _run(scans, checkpoint, apply)


class LatestPhase(StatefulProcessor):
    """Of each item of a job the latest phase event; gives what changes in the job's counts when another phase becomes the latest."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long, event_id long, phase string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        was = self.last.get() if self.last.exists() else None
        best = tuple(was) if was is not None else None
        for part in rows:
            for row in zip(part["at"], part["event_id"], part["phase"]):
                if best is None or row[:2] > best[:2]:
                    best = (int(row[0]), int(row[1]), row[2])
        if best is None or (was is not None and best == tuple(was)):
            return
        self.last.update(best)
        if was is None or was[2] != best[2]:
            changes = [(key[0], best[2], 1)] + ([(key[0], was[2], -1)] if was is not None else [])
            yield pd.DataFrame(changes, columns=["job_id", "phase", "change"])

    def close(self) -> None:
        pass


_COUNTS = StructType().add("job_id", LongType()).add("phase", StringType()).add("n", LongType())


def phase_table(spark: SparkSession, base: str, buckets: int = 64) -> BucketedTable:
    return BucketedTable(spark, base, ["job_id"], _COUNTS, buckets)


def current_phase_counts(spark: SparkSession, base: str, buckets: int = 64) -> DataFrame:
    """Per job the items by their latest phase, as ``reports.phase_counts`` gives them."""
    of = lambda p: F.coalesce(F.sum(F.when(F.col("phase") == p, F.col("n"))), F.lit(0)).alias(p)
    active = F.coalesce(F.sum(F.when(F.col("phase") != "finished", F.col("n"))), F.lit(0)).alias("active")
    return phase_table(spark, base, buckets).read().groupBy("job_id").agg(of("finished"), active, *map(of, PHASES))


def stream_phase_counts(events: DataFrame, base: str, checkpoint: str, buckets: int = 64) -> None:
    """Counts per job from phase events (job_id, item_id, ts, event_id, phase), see ``current_phase_counts``.

    The state, a row per item, lives in RocksDB and gives only changes of counts; a micro-batch rewrites the buckets of the jobs
    whose counts it changes. A batch that runs again changes nothing. An event without a time comes before all others.
    """
    spark = events.sparkSession
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(-(1 << 62)))
    rows = events.select(F.col("job_id").cast("long").alias("job_id"), F.col("item_id").cast("long").alias("item_id"), at.alias("at"), F.col("event_id").cast("long").alias("event_id"), "phase")
    changes = rows.groupBy("job_id", "item_id").transformWithStateInPandas(LatestPhase(), "job_id long, phase string, change long", "Update", "None")

    def add(rows: DataFrame, sums: DataFrame) -> DataFrame:
        both = rows.unionByName(sums.withColumnRenamed("change", "n"))
        return both.groupBy("job_id", "phase").agg(F.sum("n").alias("n")).filter("n <> 0")

    def count(batch: DataFrame, number: int) -> None:
        sums = stored(batch.groupBy("job_id", "phase").agg(F.sum("change").alias("change")).filter("change <> 0"))
        phase_table(batch.sparkSession, base, buckets).merge(sums, add, number)
        discard(sums)

    was = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS)
    try:
        _run(changes, checkpoint, count, "update")
    finally:
        spark.conf.set(STATE_STORE, was)


def stream_first_seen(keys: DataFrame, path: str, checkpoint: str, within: str | None = None, time: str = "ts", buckets: int = 256) -> None:
    """Append each key the first time that it is seen. Without ``within`` the keys seen stand in a bucketed archive beside ``path``, so the
    stream has no state: a micro-batch reads and rewrites the buckets of its own keys, and writes what was new under its number. With
    ``within`` (as '1 day') the state forgets keys after that time, and a key may come again later."""
    if within is not None:
        _run(keys.withWatermark(time, within).dropDuplicatesWithinWatermark(["value"]).select("value"), checkpoint, path=path)
        return

    def add(batch: DataFrame, number: int) -> None:
        KeyArchive(batch.sparkSession, f"{path.rstrip('/')}-archive", buckets).add(batch, number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(keys.select("value"), checkpoint, add)
