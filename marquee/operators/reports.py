"""Reports over jobs, items and failures, and what failure messages mean."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.functions.text import fold, redacted
from marquee.operators.jobs import STATUSES, TERMINAL

#: What a message has to contain, in the order in which they are tried; category, retryable, parts of the message.
FAILURE_MARKS: tuple[tuple[str, bool, tuple[str, ...]], ...] = (
    ("filename_too_long", False, ("file name too long", "filename too long", "errno 36")),
    ("disk_space", True, ("free disk space fell below the safety reserve", "download paused because free disk space fell below", "no space left on device", "disk full")),
    ("drm", False, ("drm protected", "protected by drm", "drm protection")),
    ("private", False, ("private video", "video is private", "this video is private")),
    ("deleted", False, ("video has been removed", "deleted video", "video was removed")),
    ("geo_blocked", False, ("not available in your country", "not available in your region", "geo-restricted", "geographically restricted")),
    ("age_restricted", False, ("sign in to confirm your age", "age-restricted", "age restricted")),
    ("bot_check", False, ("sign in to confirm you're not a bot", "sign in to confirm you’re not a bot")),
    ("cookie_access", False, ("could not copy chrome cookie database", "failed to decrypt with dpapi", "failed to decrypt cookie", "could not decrypt cookie", "could not be decrypted", "secretstorage not available")),
    ("po_token_required", False, ("po token", "po_token", "proof of origin")),
    ("auth_required", False, ("login required", "cookies are required", "members-only", "members only", "join this channel", "youtube premium")),
    ("rate_limit", True, ("429", "too many requests", "rate limit", "rate-limit")),
    ("forbidden", False, ("http error 403", "403: forbidden", "403 forbidden")),
    ("server", True, ("server error", "service unavailable", "bad gateway", "gateway timeout")),
    ("network", True, ("timed out", "timeout", "connection reset", "connection aborted", "remote end closed", "temporary failure in name resolution", "name or service not known", "network is unreachable", "connection refused")),
    ("live_not_ready", True, ("not yet available", "will begin", "scheduled for", "premiere will begin", "upcoming live event")),
    ("extractor", False, ("no supported javascript runtime could be found", "challenge solver", "challenge solving failed", "signature solving failed", "unable to extract yt initial data", "incomplete data received in embedded initial data", "no title found in player responses")),
    ("unavailable", False, ("video unavailable", "video is unavailable", "this video is unavailable", "no longer available", "unavailable video", "this content is unavailable")),
)
#: What a user is told of each category.
USER_MESSAGES = {
    "filename_too_long": "The generated filename exceeded the filesystem component limit.",
    "disk_space": "Download paused because the destination is low on free disk space.",
    # In words of its own: the sentence that would match names a product.
    "drm": "This media is DRM-protected; the protection is not bypassed.",
    "private": "This video is private.",
    "deleted": "This video has been removed.",
    "geo_blocked": "This media is not available in the current region.",
    "age_restricted": "This media requires authorized age-verified access.",
    "bot_check": "YouTube requested signed-in browser cookies to continue.",
    "cookie_access": "Browser cookies could not be read or decrypted. Close Chromium completely if its cookie database is locked; on Windows, use Firefox or a Netscape cookie file when Chromium App-Bound cookies cannot be decrypted.",
    "po_token_required": "YouTube requires a compatible Proof-of-Origin (PO) token for this request.",
    "auth_required": "This media requires authorized signed-in access.",
    "rate_limit": "The service is rate-limiting requests; retry later with backoff.",
    "forbidden": "YouTube returned HTTP 403 Forbidden for this media request.",
    "server": "The remote service returned a temporary server error.",
    "network": "A temporary network error interrupted the request.",
    "live_not_ready": "This scheduled/live media is not available yet.",
    "extractor": "YouTube extraction failed before availability could be determined.",
    "unavailable": "This media is unavailable.",
    "unknown": "The media request failed with an unclassified error.",
}
#: Fixed values.
SERVER_CODES = r"\b(500|502|503|504)\b"
RESTRICTED = ("auth_required", "age_restricted", "geo_blocked", "drm")
_MARKS = {name: parts for name, _, parts in FAILURE_MARKS}


def _has(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def failure_category(message: Column) -> Column:
    """The first category whose marks the message has, white space collapsed and case folded; else unknown."""
    text = fold(F.trim(F.regexp_replace(message, r"\s+", " ")))
    out = F
    for name, _, parts in FAILURE_MARKS:
        test = _has(text, parts) | text.rlike(SERVER_CODES) if name == "server" else _has(text, parts)
        out = out.when(test, name)
    return out.otherwise("unknown")


def is_retryable(category: Column) -> Column:
    return category.isin(*[name for name, again, _ in FAILURE_MARKS if again])


def user_message(category: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in USER_MESSAGES.items() for x in pair]), category)


def classify_failures(df: DataFrame, message: str = "message") -> DataFrame:
    """Add category, retryable and user_message."""
    out = df.withColumn("category", failure_category(F.col(message)))
    return out.withColumns({"retryable": is_retryable(F.col("category")), "user_message": user_message(F.col("category"))})


def attempt_log_flags(logs: DataFrame) -> DataFrame:
    """Per attempt: did a line warn of extraction, token or cookie trouble (secrets are removed before the lines are read)."""
    line = fold(redacted(F.col("line")))
    flags = {"extraction_warning": "extractor", "token_warning": "po_token_required", "cookie_warning": "cookie_access"}
    return logs.groupBy("attempt_id").agg(*[F.bool_or(_has(line, _MARKS[mark])).alias(flag) for flag, mark in flags.items()])


def promote_failures(classified: DataFrame, flags: DataFrame) -> DataFrame:
    """A forbidden failure with a token warning, a bot check with a cookie warning and an unavailable one with an extraction warning get the
    category of their cause."""
    joined = classified.join(flags, "attempt_id", "left")
    c = F.col("category")
    new = F.when((c == "forbidden") & F.col("token_warning"), "po_token_required").when((c == "bot_check") & F.col("cookie_warning"), "cookie_access").when((c == "unavailable") & F.col("extraction_warning"), "extractor").otherwise(c)
    out = joined.withColumn("category", new).withColumns({"retryable": is_retryable(F.col("category")), "user_message": user_message(F.col("category"))})
    return out.select(*classified.columns)


def jobs_with_items(jobs: DataFrame, sources: DataFrame, items: DataFrame) -> DataFrame:
    """Jobs with their source's name and items; jobs without either stay."""
    i = items.select("job_id", "item_id", F.col("status").alias("item_status"))
    return jobs.join(sources, "source_id", "left").join(i, "job_id", "left")


def job_history(jobs: DataFrame, items: DataFrame, limit: int = 20, order: tuple[str, ...] = ("updated_seq", "job_id")) -> DataFrame:
    """The last changed jobs with counts of their items. Jobs are cut to ``limit`` before items are counted."""
    if not 1 <= limit <= 200:
        raise ValueError("a history has 1 to 200 jobs")
    shown = jobs.orderBy(*[F.col(c).desc() for c in order]).limit(limit)
    status = F.col("item_status")
    per = items.select("job_id", F.col("status").alias("item_status")).join(F.broadcast(shown.select("job_id")), "job_id", "left_semi").groupBy("job_id").agg(
        F.count("*").alias("total"), F.count_if(status == "completed").alias("completed"), F.count_if(status.isin("skipped_duplicate", "skipped_unavailable")).alias("skipped"),
        F.count_if(status == "failed_retryable").alias("retryable_failed"), F.count_if(status == "failed_final").alias("final_failed"),
    )
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "completed", "skipped", "retryable_failed", "final_failed")]
    return shown.join(per, "job_id", "left").select("job_id", "status", *order[:1], *zero)


def job_breakdown(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """Per job the number of items in each status, and in all."""
    counts = items.groupBy("job_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])
    return jobs.select("job_id").join(counts, "job_id", "left").na.fill(0)


def skip_reasons(items: DataFrame) -> DataFrame:
    reason = F.coalesce(F.nullif("last_error", F.lit("")), F.lit("reason not recorded"))
    return items.filter("status = 'skipped_unavailable'").groupBy("job_id", reason.alias("reason")).agg(F.count("*").alias("n"))


def items_with_open_failures(items: DataFrame, failures: DataFrame) -> DataFrame:
    """Items with their failures that are still open; items without any stay."""
    return items.join(failures.filter("is_open").select("item_id", "seq", "category", "message"), "item_id", "left")


def failure_reasons(items: DataFrame, failures: DataFrame) -> DataFrame:
    """Per job and "category: message" (with fallbacks) the number of failed items."""
    failed = items_with_open_failures(items.filter("status IN ('failed_final', 'failed_retryable')"), failures)
    reason = F.concat(F.coalesce(F.nullif("category", F.lit("")), F.lit("unknown")), F.lit(": "), F.coalesce(F.nullif("message", F.lit("")), F.nullif("last_error", F.lit("")), F.lit("reason not recorded")))
    return failed.groupBy("job_id", reason.alias("reason")).agg(F.count_distinct("item_id").alias("n"))


def restricted_split(reasons: DataFrame) -> DataFrame:
    """Per job the skipped items that are restricted, by the reason's prefix, and the rest."""
    kind = F.substring_index("reason", ":", 1).isin(*RESTRICTED)
    out = reasons.groupBy("job_id").agg(F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0)).alias("restricted"), F.sum("n").alias("_all"))
    return out.select("job_id", "restricted", F.greatest(F.lit(0), F.col("_all") - F.col("restricted")).alias("unavailable"))


def job_progress(breakdown: DataFrame) -> DataFrame:
    s = lambda *names: reduce(lambda a, b: a + b, [F.col(n) for n in names])
    return breakdown.select(
        "job_id", "total", "pending", s("downloading", "postprocessing", "verifying").alias("active"), "completed", s("skipped_duplicate", "skipped_unavailable").alias("skipped"), "failed_retryable", "failed_final", "cancelled",
        s(*TERMINAL).alias("finished"),
    )


def execution_summary(breakdown: DataFrame, split: DataFrame) -> DataFrame:
    joined = breakdown.join(split, "job_id", "left").na.fill(0)
    return joined.select("job_id", "completed", (F.col("skipped_duplicate") + F.col("skipped_unavailable")).alias("skipped"), (F.col("failed_final") + F.col("failed_retryable")).alias("failed"), F.col("skipped_duplicate").alias("duplicate"), "unavailable", "restricted")


def derive_job_status(jobs: DataFrame, items: DataFrame) -> DataFrame:
    """(job_id, status): cancelled stays; with open items unchanged; else completed, with failures if any item failed for good."""
    per = items.groupBy("job_id").agg(F.count_if(~F.col("status").isin(*TERMINAL)).alias("_open"), F.count_if(F.col("status") == "failed_final").alias("_failed"))
    joined = jobs.join(per, "job_id", "left")
    new = F.when(F.col("status") == "cancelled", "cancelled").when(F.coalesce("_open", F.lit(0)) > 0, F.col("status")).when(F.coalesce("_failed", F.lit(0)) > 0, "completed_with_failures").otherwise("completed")
    return joined.select("job_id", new.alias("status"))


def item_status_view(items: DataFrame, media: DataFrame) -> DataFrame:
    """(job_id, position, media_key, status); callers order by position."""
    return items.join(media, "item_id").select("job_id", "position", "media_key", "status")


def collection_counts(audits: DataFrame) -> DataFrame:
    """count: reported, else listed; null if the listing failed. non_empty: it lists items or reports some."""
    n = F.when(~F.col("failed"), F.coalesce("reported_count", "item_count"))
    return audits.select("source_id", n.alias("n"), (~F.col("failed") & ((F.coalesce("item_count", F.lit(0)) > 0) | (F.coalesce("reported_count", F.lit(0)) > 0))).alias("non_empty"))


def batch_outcome(sources: DataFrame, selected: DataFrame, failed: DataFrame) -> DataFrame:
    """Per source of a batch: failed, matched or nothing matched, with its number of selected items."""
    per = selected.groupBy("source_id").agg(F.count("*").alias("n"))
    bad = failed.select("source_id", F.lit(True).alias("_failed")).distinct()
    joined = sources.join(per, "source_id", "left").join(bad, "source_id", "left")
    outcome = F.when(F.col("_failed"), "failed").when(F.coalesce("n", F.lit(0)) > 0, "matched").otherwise("nothing matched")
    return joined.select("source_id", outcome.alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))


def no_match_diagnosis(usable: DataFrame, sources: DataFrame, least: float | None, most: float | None) -> DataFrame:
    """For sources without a match: why, as far as durations tell, with the one that comes closest. They tell it only if all are known."""
    d = F.col("duration_seconds")
    per = usable.groupBy("source_id").agg(F.count("*").alias("n"), F.count(d).alias("_known"), F.min(d).alias("_min"), F.max(d).alias("_max"))
    joined = sources.join(per, "source_id", "left")
    known = F.col("_known") == F.col("n")
    long_, short = known & (F.col("_min") > F.lit(most)) if most is not None else F.lit(False), known & (F.col("_max") < F.lit(least)) if least is not None else F.lit(False)
    why = F.when(F.coalesce("n", F.lit(0)) == 0, "no usable items").when(long_, "all too long").when(short, "all too short").otherwise("no match")
    return joined.select("source_id", why.alias("reason"), F.when(why == "all too long", F.col("_min")).when(why == "all too short", F.col("_max")).alias("closest"), F.coalesce("n", F.lit(0)).alias("n"))


def selection_preview(items: DataFrame, per: str, size: str, space: str) -> DataFrame:
    """Per plan: items, total size (null if any is unknown) and a warning when it is unknown or above the space."""
    out = items.groupBy(per).agg(F.count("*").alias("n_items"), F.when(F.count_if(F.col(size).isNull()) == 0, F.sum(size)).alias("total_size"), F.min(space).alias("_space"))
    warning = F.when(F.col("total_size").isNull(), "size unknown").when(F.col("total_size") > F.col("_space"), "exceeds space").otherwise("ok")
    return out.select(per, "n_items", "total_size", warning.alias("warning"))


def latest_record(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest order of each key, as one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def latest_resumable(jobs: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """The last changed job that is paused or planned; with ``items``: of those with a retryable item."""
    rows = jobs.filter("status IN ('paused', 'planned')") if items is None else jobs.join(items.filter("status = 'failed_retryable'"), "job_id", "left_semi")
    return rows.orderBy(F.col("updated_seq").desc(), F.col("job_id").desc()).limit(1)


def next_due_item(jobs: DataFrame, items: DataFrame, now: object) -> DataFrame:
    """For every running job its first item that is pending, or retryable and due."""
    due = (F.col("status") == "pending") | ((F.col("status") == "failed_retryable") & (F.col("retry_after_at").isNull() | (F.col("retry_after_at") <= F.lit(now))))
    running = jobs.filter("status = 'running'").select("job_id")
    return items.filter(due).join(running, "job_id", "left_semi").groupBy("job_id").agg(F.min_by(F.struct("item_id", "position", "status"), "position").alias("_r")).select("job_id", "_r.*")


def phase_counts(events: DataFrame) -> DataFrame:
    """Per job the items by their latest phase: finished, active and each active phase."""
    last = events.groupBy("job_id", "item_id").agg(F.max_by("phase", F.struct("ts", "event_id")).alias("phase"))
    one = lambda p: F.count_if(F.col("phase") == p).alias(p)
    return last.groupBy("job_id").agg(one("finished"), F.count_if(F.col("phase") != "finished").alias("active"), *map(one, ("preparing", "downloading", "processing", "converting")))
