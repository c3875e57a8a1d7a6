"""Queries over jobs, items and failures."""

import datetime

from pyspark.sql import functions as F

from marquee.operators import reports as r
from marquee.operators.jobs import STATUSES
from marquee.plans.registry import query

_CLASSIFIED = "SELECT attempt_id, expected AS category FROM attempts"
_AGAIN = "category IN ('disk_space', 'rate_limit', 'server', 'network', 'live_not_ready')"
_TOLD = "CASE category " + " ".join(f"WHEN '{c}' THEN '{text}'" for c, text in r.USER_MESSAGES.items()) + " END"
query("p9_classify_failures", f"SELECT attempt_id, category, {_AGAIN} AS retryable, {_TOLD} AS user_message FROM ({_CLASSIFIED}) c")(lambda v: r.classify_failures(v.attempts).select("attempt_id", "category", "retryable", "user_message"))
query("p9_failure_summary", f"SELECT category, {_AGAIN} AS retryable, count(*) AS n FROM ({_CLASSIFIED}) c GROUP BY category")(lambda v: r.classify_failures(v.attempts).groupBy("category", "retryable").agg(F.count("*").alias("n")))
_FLAGS = "SELECT attempt_id, bool_or(line LIKE '%signature solving failed%') AS extraction_warning, bool_or(line LIKE '%PO Token%') AS token_warning, bool_or(line LIKE '%DPAPI%') AS cookie_warning FROM attempt_logs GROUP BY attempt_id"
query("p10_attempt_log_flags", _FLAGS)(lambda v: r.attempt_log_flags(v.attempt_logs))
query(
    "p11_promote_failures",
    f"""SELECT attempt_id, category, {_AGAIN} AS retryable FROM (SELECT c.attempt_id, CASE WHEN category = 'forbidden' AND token_warning THEN 'po_token_required' WHEN category = 'bot_check' AND cookie_warning THEN 'cookie_access'
 WHEN category = 'unavailable' AND extraction_warning THEN 'extractor' ELSE category END AS category FROM ({_CLASSIFIED}) c LEFT JOIN ({_FLAGS}) f ON f.attempt_id = c.attempt_id) t""",
)(lambda v: r.promote_failures(r.classify_failures(v.attempts), r.attempt_log_flags(v.attempt_logs)).select("attempt_id", "category", "retryable"))


def _sources(v):
    return v.spark.read.parquet(f"{v.sf_dir}/nation.parquet").selectExpr("n_nationkey AS source_id", "n_name AS source_name")


query("j10_jobs_with_items", "SELECT j.job_id, j.status, n_name AS source_name, item_id, i.status AS item_status FROM jobs j LEFT JOIN nation ON n_nationkey = j.source_id LEFT JOIN job_items i ON i.job_id = j.job_id")(
    lambda v: r.jobs_with_items(v.jobs, _sources(v), v.job_items).select("job_id", "status", "source_name", "item_id", "item_status")
)
_COUNTS = "count(i.item_id) AS total, count(*) FILTER (i.status = 'completed') AS completed, count(*) FILTER (i.status IN ('skipped_duplicate', 'skipped_unavailable')) AS skipped, count(*) FILTER (i.status = 'failed_retryable') AS retryable_failed, count(*) FILTER (i.status = 'failed_final') AS final_failed"
query("a1_job_history", f"SELECT j.job_id, j.status, j.updated_seq, {_COUNTS} FROM (SELECT * FROM jobs ORDER BY updated_seq DESC, job_id DESC LIMIT 200) j LEFT JOIN job_items i ON i.job_id = j.job_id GROUP BY j.job_id, j.status, j.updated_seq")(lambda v: r.job_history(v.jobs, v.job_items, 200))
_EACH = ", ".join(f"count(*) FILTER (i.status = '{s}') AS {s}" for s in STATUSES)
_BREAK = f"SELECT j.job_id, count(i.item_id) AS total, {_EACH} FROM jobs j LEFT JOIN job_items i ON i.job_id = j.job_id GROUP BY j.job_id"
query("a2_job_breakdown", _BREAK)(lambda v: r.job_breakdown(v.jobs, v.job_items))
_REASONS = "SELECT job_id, coalesce(nullif(last_error, ''), 'reason not recorded') AS reason, count(*) AS n FROM job_items WHERE status = 'skipped_unavailable' GROUP BY 1, 2"
query("a3_skip_reasons", _REASONS)(lambda v: r.skip_reasons(v.job_items))
query("j11_items_with_open_failures", "SELECT i.item_id, i.status, f.seq, f.category, f.message FROM job_items i LEFT JOIN failures f ON f.item_id = i.item_id AND f.is_open")(lambda v: r.items_with_open_failures(v.job_items, v.failures).select("item_id", "status", "seq", "category", "message"))
query(
    "a4_failure_reasons",
    """SELECT job_id, coalesce(nullif(category, ''), 'unknown') || ': ' || coalesce(nullif(message, ''), nullif(last_error, ''), 'reason not recorded') AS reason, count(DISTINCT i.item_id) AS n
 FROM job_items i LEFT JOIN failures f ON f.item_id = i.item_id AND f.is_open WHERE i.status IN ('failed_final', 'failed_retryable') GROUP BY 1, 2""",
)(lambda v: r.failure_reasons(v.job_items, v.failures))
_SPLIT = f"SELECT job_id, CAST(coalesce(sum(n) FILTER (split_part(reason, ':', 1) IN ('auth_required', 'age_restricted', 'geo_blocked', 'drm')), 0) AS BIGINT) AS restricted, CAST(sum(n) - coalesce(sum(n) FILTER (split_part(reason, ':', 1) IN ('auth_required', 'age_restricted', 'geo_blocked', 'drm')), 0) AS BIGINT) AS unavailable FROM ({_REASONS}) q GROUP BY job_id"
query("a5_restricted_split", _SPLIT)(lambda v: r.restricted_split(r.skip_reasons(v.job_items)))
query(
    "a6_job_progress",
    f"""SELECT job_id, total, pending, downloading + postprocessing + verifying AS active, completed, skipped_duplicate + skipped_unavailable AS skipped, failed_retryable, failed_final, cancelled,
 completed + skipped_duplicate + skipped_unavailable + failed_final + cancelled AS finished FROM ({_BREAK}) b""",
)(lambda v: r.job_progress(r.job_breakdown(v.jobs, v.job_items)))
query(
    "a7_execution_summary",
    f"SELECT job_id, completed, skipped_duplicate + skipped_unavailable AS skipped, failed_final + failed_retryable AS failed, skipped_duplicate AS duplicate, coalesce(s.unavailable, 0) AS unavailable, coalesce(s.restricted, 0) AS restricted FROM ({_BREAK}) b LEFT JOIN ({_SPLIT}) s USING (job_id)",
)(lambda v: r.execution_summary(r.job_breakdown(v.jobs, v.job_items), r.restricted_split(r.skip_reasons(v.job_items))))
query(
    "a8_derive_job_status",
    """SELECT j.job_id, CASE WHEN j.status = 'cancelled' THEN 'cancelled' WHEN count(*) FILTER (i.status IN ('pending', 'downloading', 'postprocessing', 'verifying', 'failed_retryable')) > 0 THEN j.status
 WHEN count(*) FILTER (i.status = 'failed_final') > 0 THEN 'completed_with_failures' ELSE 'completed' END AS status FROM jobs j LEFT JOIN job_items i ON i.job_id = j.job_id GROUP BY j.job_id, j.status""",
)(lambda v: r.derive_job_status(v.jobs, v.job_items))
query("j12_item_status_view", "SELECT job_id, position, 'm' || CAST(item_id AS VARCHAR) AS media_key, status FROM job_items WHERE item_id % 3 <> 0")(
    lambda v: r.item_status_view(v.job_items, v.media.filter("CAST(substring(media_key, 2) AS BIGINT) % 3 <> 0").selectExpr("media_key", "CAST(substring(media_key, 2) AS BIGINT) AS item_id"))
)
query("a10_collection_counts", "SELECT source_id, CASE WHEN source_id <> 'src3' THEN CASE WHEN source_id > 'src5' THEN n + 5 ELSE n END END AS n, source_id <> 'src3' AS non_empty FROM (SELECT source_id, count(*) AS n FROM media GROUP BY source_id) t")(
    lambda v: r.collection_counts(v.media.groupBy("source_id").agg(F.count("*").alias("item_count")).selectExpr("source_id", "item_count", "CASE WHEN source_id > 'src5' THEN item_count + 5 END AS reported_count", "source_id = 'src3' AS failed"))
)
query(
    "a11_batch_outcome",
    "SELECT s.source_id, CASE WHEN s.source_id = 'src4' THEN 'failed' WHEN count(m.media_key) > 0 THEN 'matched' ELSE 'nothing matched' END AS outcome, count(m.media_key) AS n FROM scans s LEFT JOIN media m ON m.source_id = s.source_id AND m.view_count > 430000 GROUP BY s.source_id",
)(lambda v: r.batch_outcome(v.scans, v.media.filter("view_count > 430000"), v.scans.filter("source_id = 'src4'")))
#: One source whose items are all too long, one whose items are all too short, and one without items.
_LENGTHS = "SELECT source_id, media_key, CASE source_id WHEN 'src1' THEN coalesce(duration_seconds, 0) + 60 WHEN 'src2' THEN coalesce(duration_seconds, 0) % 19 ELSE duration_seconds END AS duration_seconds FROM media"
_ASKED = "SELECT source_id FROM scans UNION ALL SELECT 'src99'"


def _lengths(v):
    d = F.coalesce("duration_seconds", F.lit(0.0))
    return v.media.withColumn("duration_seconds", F.when(F.col("source_id") == "src1", d + 60).when(F.col("source_id") == "src2", d % 19).otherwise(F.col("duration_seconds")))


query(
    "a12_no_match_diagnosis",
    f"""SELECT s.source_id, CASE WHEN count(m.media_key) = 0 THEN 'no usable items' WHEN count(m.media_key) = count(m.duration_seconds) AND min(m.duration_seconds) > 50 THEN 'all too long' WHEN count(m.media_key) = count(m.duration_seconds) AND max(m.duration_seconds) < 20 THEN 'all too short' ELSE 'no match' END AS reason,
 CASE WHEN count(m.media_key) = count(m.duration_seconds) AND min(m.duration_seconds) > 50 THEN min(m.duration_seconds) WHEN count(m.media_key) = count(m.duration_seconds) AND max(m.duration_seconds) < 20 THEN max(m.duration_seconds) END AS closest, count(m.media_key) AS n
 FROM ({_ASKED}) s LEFT JOIN ({_LENGTHS}) m ON m.source_id = s.source_id GROUP BY s.source_id""",
)(lambda v: r.no_match_diagnosis(_lengths(v), v.scans.select("source_id").unionByName(v.spark.sql("SELECT 'src99' AS source_id")), 20, 50))
#: One source with all sizes known, one whose sizes fit, and others with unknown sizes.
_SIZE = "CASE source_id WHEN 'src1' THEN coalesce(view_count, 0) WHEN 'src2' THEN coalesce(view_count, 0) % 7 ELSE view_count END"
query(
    "a13_selection_preview",
    f"SELECT source_id, count(*) AS n_items, CASE WHEN count(*) = count(s) THEN CAST(sum(s) AS BIGINT) END AS total_size, CASE WHEN count(*) <> count(s) THEN 'size unknown' WHEN sum(s) > 900000 THEN 'exceeds space' ELSE 'ok' END AS warning FROM (SELECT source_id, {_SIZE} AS s FROM media) t GROUP BY source_id",
)(lambda v: r.selection_preview(v.media.withColumn("view_count", F.expr(_SIZE)).withColumn("space", F.lit(900000)), "source_id", "view_count", "space"))
_PHASES = "SELECT job_id, item_id, phase FROM (SELECT *, row_number() OVER (PARTITION BY job_id, item_id ORDER BY ts DESC, event_id DESC) AS n FROM phase_events) t WHERE n = 1"
PHASE_COUNTS = f"SELECT job_id, count(*) FILTER (phase = 'finished') AS finished, count(*) FILTER (phase <> 'finished') AS active, count(*) FILTER (phase = 'preparing') AS preparing, count(*) FILTER (phase = 'downloading') AS downloading, count(*) FILTER (phase = 'processing') AS processing, count(*) FILTER (phase = 'converting') AS converting FROM ({_PHASES}) p GROUP BY job_id"
query("a14_phase_counts", PHASE_COUNTS)(lambda v: r.phase_counts(v.phase_events))
query("w8_latest_record", "SELECT media_key, download_id, path FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY download_id DESC) AS n FROM downloads WHERE status = 'completed') t WHERE n = 1")(
    lambda v: r.latest_record(v.downloads.filter("status = 'completed'").select("media_key", "download_id", "path"), ["media_key"], ["download_id"])
)
query("w8_latest_resumable", "SELECT job_id, status FROM jobs WHERE status IN ('paused', 'planned') ORDER BY updated_seq DESC, job_id DESC LIMIT 1")(lambda v: r.latest_resumable(v.jobs).select("job_id", "status"))
query("w8_latest_retryable", "SELECT job_id, status FROM jobs j WHERE EXISTS (SELECT 1 FROM job_items i WHERE i.job_id = j.job_id AND i.status = 'failed_retryable') ORDER BY updated_seq DESC, job_id DESC LIMIT 1")(lambda v: r.latest_resumable(v.jobs, v.job_items).select("job_id", "status"))
query(
    "w9_next_due_item",
    """SELECT job_id, item_id, position, status FROM (SELECT i.*, row_number() OVER (PARTITION BY i.job_id ORDER BY position) AS n FROM job_items i JOIN jobs j ON j.job_id = i.job_id AND j.status = 'running'
 WHERE i.status = 'pending' OR (i.status = 'failed_retryable' AND (retry_after_at IS NULL OR retry_after_at <= DATE '1996-01-01'))) t WHERE n = 1""",
)(lambda v: r.next_due_item(v.jobs, v.job_items, datetime.date(1996, 1, 1)))
