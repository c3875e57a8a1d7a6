"""Queries over bulk status changes and validation."""

import datetime

from pyspark.sql import functions as F

from marquee.operators import jobs as j
from marquee.operators import reports as r
from marquee.plans.registry import query

_NOW = datetime.datetime(1998, 1, 1)
_DAY = datetime.date(1996, 1, 1)
_T = "('downloading', 'postprocessing', 'verifying')"


def _selected(v):
    return v.media.selectExpr("source_id AS job_id", "media_key", "position + 1 AS rank").unionByName(v.media.filter("position = 3 AND source_id = 'src2'").selectExpr("source_id AS job_id", "media_key", "99L AS rank"))


def _existing(v):
    return v.spark.sql("SELECT 'src5' AS job_id")


query("b7_create_job_items", "SELECT source_id AS job_id, media_key, position, 'pending' AS status, CAST(0 AS BIGINT) AS attempts FROM media WHERE source_id NOT IN ('src2', 'src5')")(lambda v: j.create_job_items(_selected(v), _existing(v)))
query("b7_rejected_jobs", "SELECT 'src2' AS job_id, 'repeated item' AS reason UNION ALL SELECT 'src5', 'exists'")(lambda v: j.rejected_jobs(_selected(v), _existing(v)))


def _item_failures(v):
    return v.failures.filter("seq = 1").select("item_id", "category", "message", F.col("category").isin("network", "server").alias("retryable"))


_HIT = "f.item_id IS NOT NULL AND i.status IN ('downloading', 'postprocessing', 'verifying')"
_ONE = "(SELECT item_id, category, message, category IN ('network', 'server') AS retryable FROM failures WHERE seq = 1)"
query(
    "b8_apply_failures",
    f"""SELECT i.item_id, CASE WHEN {_HIT} AND f.retryable AND i.attempts < 5 THEN 'failed_retryable' WHEN {_HIT} THEN 'failed_final' ELSE i.status END AS status,
 CASE WHEN {_HIT} AND f.retryable AND i.attempts < 5 THEN TIMESTAMP '1998-01-01 00:00:00' + to_seconds(least(CAST(2 * pow(2, greatest(i.attempts, 1) - 1) AS BIGINT), 10)) END AS due_at FROM job_items i LEFT JOIN {_ONE} f ON f.item_id = i.item_id""",
)(lambda v: j.apply_failures(v.job_items, _item_failures(v), _NOW, cap=10).select("item_id", "status", "due_at"))
query("b8_failure_rows", f"SELECT f.item_id, f.category, f.message, f.retryable AND i.attempts < 5 AS retryable FROM job_items i JOIN {_ONE} f ON f.item_id = i.item_id WHERE i.status IN {_T}")(lambda v: j.failure_rows(v.job_items, _item_failures(v)))
query(
    "b9_apply_completions",
    f"""SELECT job_id, item_id, CASE WHEN item_id % 2 = 0 AND status IN {_T} THEN CASE WHEN item_id % 4 = 0 THEN 'completed' ELSE 'skipped_duplicate' END ELSE status END AS status,
 CASE WHEN item_id % 2 = 0 AND status IN {_T} THEN '/out/' || CAST(item_id AS VARCHAR) END AS output_path, CASE WHEN item_id % 2 = 0 AND status IN {_T} THEN NULL ELSE last_error END AS last_error FROM job_items""",
)(lambda v: j.apply_completions(v.job_items, v.job_items.filter("item_id % 2 = 0").selectExpr("item_id", "CASE WHEN item_id % 4 = 0 THEN 'completed' ELSE 'skipped_duplicate' END AS outcome", "'/out/' || item_id AS path", "CAST(NULL AS STRING) AS detail")))


def _classified(v):
    return r.classify_failures(v.attempts).withColumn("job_id", F.col("attempt_id") % 40)


_SKIPPED, _PAUSED = "expected IN ('private', 'deleted', 'geo_blocked', 'auth_required', 'age_restricted', 'drm', 'unavailable')", "expected IN ('bot_check', 'cookie_access', 'po_token_required')"
query(
    "b10_outcome_from_failure",
    f"SELECT attempt_id, CASE WHEN {_SKIPPED} THEN 'skipped_unavailable' WHEN {_PAUSED} THEN 'pause' ELSE 'fail' END AS outcome, CASE WHEN {_SKIPPED} THEN expected || ': ' || message END AS detail, {_PAUSED} AS pause FROM attempts",
)(lambda v: j.outcome_from_failure(_classified(v)).select("attempt_id", "outcome", "detail", "pause"))
query("b10_jobs_to_pause", f"SELECT attempt_id % 40 AS job_id, bool_or({_PAUSED}) AS pause FROM attempts GROUP BY 1")(lambda v: j.jobs_to_pause(j.outcome_from_failure(_classified(v))))


def _moved(when: str, to: str = "pending", **cleared: str) -> str:
    cols = {"attempts": "i.attempts", "retry_after_at": "i.retry_after_at", "last_error": "i.last_error"}
    rest = ", ".join(f"CASE WHEN {when} THEN {cleared[c]} ELSE {x} END AS {c}" if c in cleared else f"{x} AS {c}" for c, x in cols.items())
    return f"SELECT i.job_id, i.item_id, i.position, CASE WHEN {when} THEN '{to}' ELSE i.status END AS status, {rest} FROM job_items i JOIN jobs j ON j.job_id = i.job_id"


_ANEW = {"attempts": "0", "retry_after_at": "NULL", "last_error": "NULL"}
query("b11_requeue_due", _moved("j.status = 'running' AND i.status = 'failed_retryable' AND (i.retry_after_at IS NULL OR i.retry_after_at <= DATE '1996-01-01')", retry_after_at="NULL"))(lambda v: j.requeue_due(v.job_items, v.jobs, _DAY))
query("b12_requeue_retryable", _moved("j.status <> 'cancelled' AND i.status = 'failed_retryable'", retry_after_at="NULL"))(lambda v: j.requeue_retryable(v.job_items, v.jobs))
query("b12_resolve_failures", "SELECT f.item_id, f.seq, f.is_open AND NOT coalesce(j.status <> 'cancelled' AND i.status = 'failed_retryable', FALSE) AS is_open, f.category, f.message FROM failures f LEFT JOIN job_items i ON i.item_id = f.item_id LEFT JOIN jobs j ON j.job_id = i.job_id")(
    lambda v: j.resolve_failures(v.failures, v.job_items, j.requeue_retryable(v.job_items, v.jobs))
)
query("b13_requeue_unavailable", _moved("j.status IN ('planned', 'paused', 'completed', 'completed_with_failures') AND i.status = 'skipped_unavailable'", **_ANEW))(lambda v: j.requeue_unavailable(v.job_items, v.jobs))
query("b14_requeue_final", _moved("j.status IN ('planned', 'paused', 'completed', 'completed_with_failures') AND i.status = 'failed_final'", **_ANEW))(lambda v: j.requeue_final(v.job_items, v.jobs))
query("b15_recover_interrupted", _moved(f"j.status = 'running' AND i.status IN {_T}", last_error="'interrupted'"))(lambda v: j.recover_interrupted(v.job_items, v.jobs))
query("b16_cancel_jobs", _moved("j.status <> 'cancelled' AND j.job_id % 6 = 1 AND i.status IN ('pending', 'downloading', 'postprocessing', 'verifying', 'failed_retryable')", "cancelled"))(lambda v: j.cancel_jobs(v.job_items, v.jobs, v.jobs.filter("job_id % 6 = 1").select("job_id")))

query("v1_repeated_items", "SELECT source_id, media_key, count(*) AS n FROM scan2 GROUP BY source_id, media_key HAVING count(*) > 1")(lambda v: j.repeated_items(v.scan2, ["source_id", "media_key"]))
query(
    "v2_table_constraints",
    """SELECT 'scan2' AS table_name, 'unique media_key' AS rule, count(*) - count(DISTINCT media_key) AS n FROM scan2 UNION ALL SELECT 'scan2', 'views at least 2000', count(*) FILTER (view_count < 2000) FROM scan2
 UNION ALL SELECT 'scan2', 'source_id refers to source_id', count(*) FILTER (source_id = 'src7') FROM scan2""",
)(lambda v: j.constraint_violations(v.scan2, "scan2", [["media_key"]], {"views at least 2000": "view_count >= 2000"}, {"source_id": (v.scans.filter("source_id <> 'src7'"), "source_id")}))
query("v3_unknown_statuses", "SELECT CASE WHEN position % 3 = 0 THEN 'lost' END AS status, count(*) AS n FROM job_items WHERE position % 3 = 0 OR position % 7 = 1 GROUP BY 1")(
    lambda v: j.unknown_statuses(v.job_items.withColumn("status", F.expr("CASE WHEN position % 3 = 0 THEN 'lost' WHEN position % 7 = 1 THEN NULL ELSE status END")))
)
query("v4_verify_snapshots", "SELECT source_id, source_id NOT IN ('src1', 'src2') AS valid FROM scans")(
    lambda v: j.verify_snapshots(v.media.filter("NOT (source_id = 'src1' AND position = 5)").withColumn("title", F.expr("CASE WHEN source_id = 'src2' AND position = 0 THEN 'forged' ELSE title END")), j.selection_hash(v.media, "source_id", ["media_key", "title"]).drop("n_items"), "source_id", ["media_key", "title"])
)
_ALLOWED = ", ".join(f"('{a}', '{b}')" for a, bs in j.NEXT.items() for b in bs)
query("v5_illegal_transitions", f"SELECT item_id, seq, previous, status FROM (SELECT *, lag(status) OVER (PARTITION BY item_id ORDER BY seq) AS previous FROM statuses) t WHERE previous IS NOT NULL AND previous <> status AND (previous, status) NOT IN ({_ALLOWED})")(lambda v: j.illegal_transitions(v.statuses))
