"""Queries over streams: the tables are dealt to several files, and read as a stream of micro-batches."""

import uuid

from pyspark.sql import functions as F

from marquee.plans.registry import ORACLE_SQL, query
from marquee.plans.reports import PHASE_COUNTS
from marquee.sources.tables import shared_dir
from marquee.streaming import streams as t


def _stream(df, base, files=4, per_batch=2):
    """``df`` as a stream of several files."""
    path = f"{base}/in"
    df.repartition(files).write.parquet(path)
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _base(v):
    return f"{shared_dir(v.spark)}/stream-{uuid.uuid4().hex}"


def _indexed(v):
    """The folder of an index that two rounds of scans went into."""
    base = _base(v)
    first = v.scan1.withColumn("complete", F.lit(True))
    for rows in (first, v.scan2.withColumn("complete", F.col("source_id") != "src0")):
        rows.select(first.columns).repartition(1).write.mode("append").parquet(f"{base}/in")
        t.stream_index(v.spark.readStream.schema(first.schema).parquet(f"{base}/in"), f"{base}/index", f"{base}/checkpoint", 16)
    return f"{base}/index"


def _index(v):
    return v.spark.read.parquet(f"{_indexed(v)}/audits").filter("batch = 1").select("source_id", "item_count", "added", "metadata_updated", "stats_updated", "unchanged", "missing")


def _index_table(v, which):
    return t.index_tables(v.spark, _indexed(v), v.scan1, 16)[which].read()


def _phases(v):
    base = _base(v)
    t.stream_phase_counts(_stream(v.phase_events, base), f"{base}/counts", f"{base}/checkpoint", 16)
    return t.current_phase_counts(v.spark, f"{base}/counts", 16)


def _keys(v):
    base = _base(v)
    t.stream_first_seen(_stream(v.phase_events.selectExpr("'youtube ' || item_id AS value", "ts"), base), f"{base}/out", f"{base}/checkpoint")
    return v.spark.read.parquet(f"{base}/out").select("value")


query("t1_stream_index")(_index)
ORACLE_SQL["t1_stream_index"] = ORACLE_SQL["a9_scan_diff_summary"]
_LAST = "(SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY source_id DESC, position DESC) AS n FROM scan2 {})"
_NEW = ", ".join(f"CASE WHEN b.n IS NULL THEN a.{c} ELSE b.{c} END AS {c}" for c in t.FIELDS)
_NEW_STATS = ", ".join(f"CASE WHEN s.n IS NULL THEN a.{c} ELSE s.{c} END AS {c}" for c in t.STATS)
query(
    "t1_index_media",
    f"""SELECT media_key, {_NEW}, {_NEW_STATS} FROM scan1 a FULL JOIN (SELECT * FROM {_LAST.format('')} t WHERE n = 1) b USING (media_key)
 FULL JOIN (SELECT * FROM {_LAST.format('WHERE view_count IS NOT NULL OR like_count IS NOT NULL')} t WHERE n = 1) s USING (media_key)""",
)(lambda v: _index_table(v, 0))
query(
    "t1_index_members",
    """SELECT source_id, media_key, coalesce(b.position, a.position) AS position, CASE WHEN b.position IS NOT NULL THEN TRUE ELSE source_id = 'src0' END AS is_present, CAST(CASE WHEN b.position IS NOT NULL THEN 1 ELSE 0 END AS BIGINT) AS last_seen
 FROM scan1 a FULL JOIN (SELECT source_id, media_key, max(position) AS position FROM scan2 GROUP BY source_id, media_key) b USING (source_id, media_key)""",
)(lambda v: _index_table(v, 1))
query("t2_stream_phase_counts", PHASE_COUNTS)(_phases)
query("t3_stream_first_seen", "SELECT DISTINCT 'youtube ' || CAST(item_id AS VARCHAR) AS value FROM phase_events")(_keys)
