"""Job items in bulk: creation, failures, completions, requeues, and validation. Change sets join the table; a new table results."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.operators.ordering import before
from marquee.sources.tables import stored

#: Item and job statuses.
STATUSES = ("pending", "downloading", "postprocessing", "verifying", "completed", "skipped_duplicate", "skipped_unavailable", "failed_retryable", "failed_final", "cancelled")
TRANSIENT = ("downloading", "postprocessing", "verifying")
TERMINAL = ("completed", "skipped_duplicate", "skipped_unavailable", "failed_final", "cancelled")
JOB_STATUSES = ("planned", "running", "paused", "completed", "completed_with_failures", "cancelled")
JOB_TERMINAL = ("completed", "completed_with_failures", "cancelled")
#: Failure categories that make an item unavailable, and those that pause its whole job.
UNAVAILABLE = ("private", "deleted", "geo_blocked", "auth_required", "age_restricted", "drm", "unavailable")
PAUSING = ("bot_check", "cookie_access", "po_token_required")
#: Steps that a status may take next.
NEXT = {
    "pending": ("downloading", "cancelled"), "downloading": ("postprocessing", "verifying", "completed", "skipped_duplicate", "skipped_unavailable", "failed_retryable", "failed_final", "pending", "cancelled"),
    "postprocessing": ("verifying", "completed", "skipped_duplicate", "skipped_unavailable", "failed_retryable", "failed_final", "pending", "cancelled"),
    "verifying": ("completed", "skipped_duplicate", "skipped_unavailable", "failed_retryable", "failed_final", "pending", "cancelled"),
    "failed_retryable": ("downloading", "pending", "cancelled"), "failed_final": ("pending",), "skipped_unavailable": ("pending",),
}
_BLOCK = 1000


def _canonical(columns: list[str]) -> Column:
    """The columns as a JSON object with sorted keys and no spaces; nulls are named."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def selection_hash(items: DataFrame, per: str, columns: list[str]) -> DataFrame:
    """(per, content_hash, n_items): SHA-256 over the rows' canonical JSON in position order. Blocks of positions are hashed first, so no
    group is gathered whole; equal rows in another order give another hash."""
    placed = items.select(per, F.floor(F.col("position") / _BLOCK).alias("_block"), "position", F.sha2(_canonical(columns), 256).alias("_h"))
    joined = lambda order, value: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), ","), 256)
    blocks = placed.groupBy(per, "_block").agg(joined("position", "_h").alias("_b"), F.count("*").alias("_n"))
    return blocks.groupBy(per).agg(joined("_block", "_b").alias("content_hash"), F.sum("_n").alias("n_items"))


def hashed_rows(items: DataFrame, per: str, columns: list[str]) -> DataFrame:
    """(per, position, h), h being the hash of all rows at a position."""
    rows = items.select(per, F.col("position").cast("long").alias("position"), F.sha2(_canonical(columns), 256).alias("h"))
    return rows.groupBy(per, "position").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))


def hash_tree(rows: DataFrame, per: str, block: int = _BLOCK, fan: int = 16, levels: int = 5) -> DataFrame:
    """(per, level, node, hash) over rows (per, position, h). Level 0 has a node for ``block`` positions; a node of a level above covers
    ``fan`` nodes of the one below, and the highest level covers what is left. A node depends on the places and hashes of its own rows only."""
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: F.concat_ws(":", x["place"], x["hash"])), ","), 256).alias("hash")
    level = rows.select(per, F.floor(F.col("position") / block).alias("node"), F.col("position").alias("place"), F.col("h").alias("hash")).groupBy(per, "node").agg(joined)
    out = level.withColumn("level", F.lit(0))
    for n in range(1, levels):
        level = level.select(per, F.floor(F.col("node") / (fan if n < levels - 1 else 1 << 40)).alias("node"), F.col("node").alias("place"), "hash").groupBy(per, "node").agg(joined)
        out = out.unionByName(level.withColumn("level", F.lit(n)))
    return out.select(per, "level", F.col("node").cast("long").alias("node"), "hash")


def differing_blocks(one: DataFrame, other: DataFrame, per: str, fan: int = 16, levels: int = 5) -> DataFrame:
    """(per, block) of level 0 where two trees differ, or one of them has no node, found from the top: only children of nodes that differ
    are compared, so trees that agree are compared at their tops alone."""
    open_ = None
    for n in range(levels - 1, -1, -1):
        sides = []
        for tree, name in ((one, "a"), (other, "b")):
            side = tree.filter(F.col("level") == n).select(per, "node", F.col("hash").alias(name))
            if open_ is not None:
                above = F.floor(F.col("node") / (fan if n < levels - 2 else 1 << 40)).cast("long")
                side = side.withColumn("_above", above).join(open_, [per, "_above"], "left_semi").drop("_above")
            sides.append(side)
        open_ = stored(sides[0].join(sides[1], [per, "node"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select(per, F.col("node").alias("_above")))
    return open_.select(per, F.col("_above").alias("block"))


def differing_rows(one: DataFrame, other: DataFrame, blocks: DataFrame, per: str, block: int = _BLOCK) -> DataFrame:
    """(per, position, problem) of rows (per, position, h) in ``blocks``: missing in the second, added there, or changed."""
    side = lambda rows, name: rows.withColumn("block", F.floor(F.col("position") / block).cast("long")).join(blocks, [per, "block"], "left_semi").select(per, "position", F.col("h").alias(name))
    both = side(one, "a").join(side(other, "b"), [per, "position"], "full")
    problem = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed")
    return both.withColumn("problem", problem).filter("problem IS NOT NULL").select(per, "position", "problem")


def plan_hash(items: DataFrame, per: str, columns: list[str], settings: DataFrame) -> DataFrame:
    """(per, content_hash): SHA-256 of the canonical JSON of a plan's settings (all other columns of ``settings``, one row per plan: source,
    format, quality, mode, directory, label, sort) and of its items' hash. Ids and times stay out if they are no columns."""
    both = settings.join(selection_hash(items, per, columns).withColumnRenamed("content_hash", "items"), per)
    return both.select(per, F.sha2(_canonical(["items", *[c for c in settings.columns if c != per]]), 256).alias("content_hash"))


def verify_snapshots(items: DataFrame, hashes: DataFrame, per: str, columns: list[str]) -> DataFrame:
    """(per, valid): whether the recomputed hash equals the stored one; a missing side is invalid."""
    now = selection_hash(items, per, columns).withColumnRenamed("content_hash", "_now")
    return hashes.join(now, per, "full").select(per, F.coalesce(F.col("content_hash") == F.col("_now"), F.lit(False)).alias("valid"))


def retry_delay(attempts: Column, base: float = 2.0, cap: float = 120.0) -> Column:
    """Seconds until the next attempt: doubling from ``base``, ``cap`` at most."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempts - 1), F.lit(float(cap)))


def due_at(now: datetime.datetime, seconds: Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def create_job_items(selected: DataFrame, existing: DataFrame, job: str = "job_id", key: str = "media_key") -> DataFrame:
    """Pending items with positions from 0 in rank order, for jobs that don't exist yet and repeat no key (``rejected_jobs`` has the others)."""
    bad = rejected_jobs(selected, existing, job, key).select(job)
    fresh = before(selected.select(job, key, "rank").join(bad, job, "left_anti"), [job, "rank"], [job], out="position")
    return fresh.select(job, key, "position", F.lit("pending").alias("status"), F.lit(0).cast("long").alias("attempts"))


def rejected_jobs(selected: DataFrame, existing: DataFrame, job: str = "job_id", key: str = "media_key") -> DataFrame:
    """(job, reason)."""
    twice = selected.groupBy(job, key).agg(F.count("*").alias("n")).filter("n > 1").select(job, F.lit("repeated item").alias("reason"))
    old = selected.select(job).distinct().join(existing.select(job).distinct(), job, "left_semi").select(job, F.lit("exists").alias("reason"))
    return twice.unionByName(old).distinct()


def apply_failures(items: DataFrame, failures: DataFrame, now: datetime.datetime, most: int = 5, base: float = 2.0, cap: float = 120.0) -> DataFrame:
    """Items with failures (item_id, category, message, retryable) applied: retryable ones below ``most`` attempts wait until due_at,
    the others fail for good. Only transient items take a failure."""
    f = failures.select("item_id", "category", "message", "retryable")
    joined = items.join(f, "item_id", "left")
    hit = F.col("category").isNotNull() & F.col("status").isin(*TRANSIENT)
    again = hit & F.col("retryable") & (F.col("attempts") < most)
    status = F.when(again, "failed_retryable").when(hit, "failed_final").otherwise(F.col("status"))
    due = F.when(again, due_at(now, retry_delay(F.greatest("attempts", F.lit(1)), base, cap)))
    error = F.when(hit, F.col("message")).otherwise(F.col("last_error"))
    return joined.select("job_id", "item_id", "position", status.alias("status"), "attempts", due.alias("due_at"), error.alias("last_error"))


def failure_rows(items: DataFrame, failures: DataFrame, most: int = 5) -> DataFrame:
    """Rows for the failure log: applied failures with their effective retryability."""
    hit = items.filter(F.col("status").isin(*TRANSIENT)).join(failures, "item_id")
    return hit.select("item_id", "category", "message", (F.col("retryable") & (F.col("attempts") < most)).alias("retryable"))


def apply_completions(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Transient items with outcomes (item_id, outcome, path, detail) applied; outcome is completed or a skip."""
    o = outcomes.select("item_id", "outcome", F.col("path").alias("output_path"), "detail")
    joined = items.join(o, "item_id", "left")
    hit = F.col("outcome").isin("completed", "skipped_duplicate", "skipped_unavailable") & F.col("status").isin(*TRANSIENT)
    return joined.select(
        "job_id", "item_id", F.when(hit, F.col("outcome")).otherwise(F.col("status")).alias("status"), F.when(hit, F.col("output_path")).alias("output_path"),
        F.when(hit, F.col("detail")).otherwise(F.col("last_error")).alias("last_error"),
    )


def outcome_from_failure(failures: DataFrame) -> DataFrame:
    """(…, outcome, detail, pause): unavailable categories skip the item, access categories pause its job, the rest fail it."""
    skip, pause = F.col("category").isin(*UNAVAILABLE), F.col("category").isin(*PAUSING)
    outcome = F.when(skip, "skipped_unavailable").when(pause, "pause").otherwise("fail")
    return failures.withColumns({"outcome": outcome, "detail": F.when(skip, F.concat_ws(": ", "category", "message")), "pause": F.coalesce(pause, F.lit(False))})


def jobs_to_pause(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("job_id").agg(F.bool_or("pause").alias("pause"))


def _of_jobs(items: DataFrame, jobs: DataFrame, statuses: tuple[str, ...]) -> DataFrame:
    """Items with ``_in``: their job has one of the statuses."""
    marked = jobs.filter(F.col("status").isin(*statuses)).select("job_id", F.lit(True).alias("_in"))
    return items.join(marked, "job_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def _move(items: DataFrame, when: Column, to: str, cleared: dict[str, Column]) -> DataFrame:
    out = items.withColumn("_when", F.coalesce(when, F.lit(False)))
    out = out.withColumns({"status": F.when(F.col("_when"), to).otherwise(F.col("status"))} | {c: F.when(F.col("_when"), v).otherwise(F.col(c)) for c, v in cleared.items()})
    return out.drop("_when", "_in")


def _null(items: DataFrame, c: str) -> Column:
    return F.lit(None).cast(dict(items.dtypes)[c])


def requeue_due(items: DataFrame, jobs: DataFrame, now: object) -> DataFrame:
    """Retryable items of running jobs whose time has come are pending again."""
    due = F.col("retry_after_at").isNull() | (F.col("retry_after_at") <= F.lit(now))
    return _move(_of_jobs(items, jobs, ("running",)), F.col("_in") & (F.col("status") == "failed_retryable") & due, "pending", {"retry_after_at": _null(items, "retry_after_at")})


def requeue_retryable(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """All retryable items of jobs that have not ended are pending again; ``resolve_failures`` closes their failures."""
    open_jobs = tuple(s for s in JOB_STATUSES if s not in ("cancelled",))
    return _move(_of_jobs(items, jobs, open_jobs), F.col("_in") & (F.col("status") == "failed_retryable"), "pending", {"retry_after_at": _null(items, "retry_after_at")})


def _recover(items: DataFrame, jobs: DataFrame, status: str) -> DataFrame:
    idle = tuple(s for s in JOB_STATUSES if s not in ("running", "cancelled"))
    cleared = {"attempts": F.lit(0).cast("long"), "retry_after_at": _null(items, "retry_after_at"), "last_error": _null(items, "last_error")}
    return _move(_of_jobs(items, jobs, idle), F.col("_in") & (F.col("status") == status), "pending", cleared)


def requeue_unavailable(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Unavailable items of jobs that don't run start anew; ``paused_by`` tells which jobs become paused."""
    return _recover(items, jobs, "skipped_unavailable")


def requeue_final(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Items that failed for good start anew, likewise."""
    return _recover(items, jobs, "failed_final")


def resolve_failures(failures: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Open failures of items that went back to pending are resolved."""
    back = before.filter("status <> 'pending'").join(after.filter("status = 'pending'").select("item_id"), "item_id", "left_semi").select("item_id", F.lit(True).alias("_back")).distinct()
    return failures.join(back, "item_id", "left").withColumn("is_open", F.col("is_open") & F.col("_back").isNull()).drop("_back")


def recover_interrupted(items: DataFrame, jobs: DataFrame) -> DataFrame:
    """Transient items of running jobs are pending again, with a note."""
    return _move(_of_jobs(items, jobs, ("running",)), F.col("_in") & F.col("status").isin(*TRANSIENT), "pending", {"last_error": F.lit("interrupted")})


def cancel_jobs(items: DataFrame, jobs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Items of the chosen jobs (job_id) that have not ended are cancelled; jobs that have ended are left alone."""
    picked = jobs.filter(~F.col("status").isin(*JOB_TERMINAL)).join(chosen, "job_id", "left_semi")
    return _move(_of_jobs(items, picked, JOB_STATUSES), F.col("_in") & ~F.col("status").isin(*TERMINAL), "cancelled", {})


def repeated_items(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def assert_unique_items(df: DataFrame, keys: list[str]) -> None:
    bad = repeated_items(df, keys).limit(1).collect()
    if bad:
        raise ValueError(f"repeated: {bad[0].asDict()}")


def constraint_violations(df: DataFrame, name: str, unique: list[list[str]] = (), checks: dict[str, str] | None = None, references: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(table, rule, n): violations of unique keys (rows beyond the first), checks (SQL that must not be false) and references."""
    found = []
    for keys in unique:
        n = repeated_items(df, keys).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
        found.append(n.select(F.lit(f"unique {', '.join(keys)}").alias("rule"), "n"))
    for rule, sql in (checks or {}).items():
        found.append(df.agg(F.count_if(~F.expr(sql)).alias("n")).select(F.lit(rule).alias("rule"), "n"))
    for column, (other, key) in (references or {}).items():
        lost = df.filter(F.col(column).isNotNull()).join(other.select(F.col(key).alias(column)), column, "left_anti")
        found.append(lost.agg(F.count("*").alias("n")).select(F.lit(f"{column} refers to {key}").alias("rule"), "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.select(F.lit(name).alias("table_name"), "rule", F.col("n").cast("long").alias("n"))


def unknown_statuses(df: DataFrame, allowed: tuple[str, ...] = STATUSES) -> DataFrame:
    return df.filter(~F.coalesce(F.col("status").isin(*allowed), F.lit(False))).groupBy("status").agg(F.count("*").alias("n"))


def illegal_transitions(log: DataFrame, key: str = "item_id", order: str = "seq") -> DataFrame:
    """Steps of a status log (previous, status) that NEXT doesn't allow, with their place; a status that stays is no step."""
    rows = [(a, b) for a, bs in NEXT.items() for b in bs]
    allowed = log.sparkSession.createDataFrame(rows, "previous string, status string")
    steps = log.withColumn("previous", F.lag("status").over(Window.partitionBy(key).orderBy(order))).filter("previous IS NOT NULL AND previous <> status")
    return steps.join(F.broadcast(allowed), ["previous", "status"], "left_anti").select(key, order, "previous", "status")
