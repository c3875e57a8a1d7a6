"""Scans against the index: enrichment, freshness, what changed, and upserts. Bulk joins; a new table replaces the old one."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions.text import clean_text
from marquee.operators.filters import is_missing

STATS = ("view_count", "like_count", "comment_count")
KEYS = ("source_id", "media_key", "position", "scan_seq")


def enrich_metadata(items: DataFrame, details: DataFrame, required: set[str]) -> DataFrame:
    """Items with fields filled in from ``details`` (media_key, fields) where any required one is missing; a detail that is null, blank
    or negative leaves the old value. ``changed`` marks rows that differ."""
    fields = [c for c in details.columns if c in items.columns and c not in KEYS]
    kinds = dict(items.dtypes)
    new = details.select("media_key", *[F.col(c).alias(f"_new_{c}") for c in fields])
    joined = items.join(new, "media_key", "left")
    lacks = F.lit(False)
    for c in sorted(required):
        lacks = lacks | is_missing(c)

    def cleaned(c: str) -> Column:
        n = F.col(f"_new_{c}")
        return clean_text(n) if kinds[c] == "string" else n if kinds[c] in ("date", "boolean") else F.when(n >= 0, n).cast(kinds[c])

    values = {c: F.when(lacks, F.coalesce(cleaned(c), F.col(c))).otherwise(F.col(c)) for c in fields}
    changed = F.lit(False)
    for c in fields:
        changed = changed | ~values[c].eqNullSafe(F.col(c))
    out = joined.withColumn("changed", changed)
    return out.select(*[values[c].alias(c) if c in values else F.col(c) for c in items.columns], "changed")


def freshness_due(media: DataFrame, refreshes: DataFrame, group: str, now: datetime.datetime | datetime.date) -> DataFrame:
    """(media_key, due): never refreshed, last status not ok, no expiry, or expired at ``now``."""
    last = refreshes.filter(F.col("group_name") == group).select("media_key", "status", "expires_at", F.lit(True).alias("_seen"))
    due = F.col("_seen").isNull() | (F.col("status") != "ok") | F.col("expires_at").isNull() | (F.col("expires_at") <= F.lit(now))
    return media.select("media_key").distinct().join(last, "media_key", "left").select("media_key", F.coalesce(due, F.lit(True)).alias("due"))


def missing_members(members: DataFrame, scan: DataFrame, scans: DataFrame) -> DataFrame:
    """Members (source_id, media_key) that a complete scan of their source no longer lists."""
    complete = scans.filter("complete").select("source_id")
    return members.join(complete, "source_id", "left_semi").join(scan, ["source_id", "media_key"], "left_anti")


def scan_row_flags(index: DataFrame, scan: DataFrame, fields: list[str], stats: list[str]) -> DataFrame:
    """Scan rows with added, metadata_updated, stats_updated and unchanged, as if applied one after another.

    A key that a scan repeats is compared with its previous row. Rows of one key meet in one window, whatever
    their source; a key has few rows, so no hot partition can arise.
    """
    known = F.struct(*[F.col(c) for c in fields])
    counted = F.when(F.coalesce(*[F.col(c) for c in stats]).isNotNull(), F.struct(*[F.col(c) for c in stats]))
    old = index.select("media_key", F.lit("").alias("source_id"), F.lit(-1).cast("long").alias("position"), known.alias("_m"), counted.alias("_s"), F.lit(False).alias("_scan"))
    new = scan.select("media_key", "source_id", "position", known.alias("_m"), counted.alias("_s"), F.lit(True).alias("_scan"))
    w = Window.partitionBy("media_key").orderBy("_scan", "source_id", "position")
    rows = old.unionByName(new).withColumns({"_n": F.row_number().over(w), "_pm": F.lag("_m").over(w), "_ps": F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))}).filter("_scan")
    added = F.col("_n") == 1
    meta = ~added & ~F.col("_m").eqNullSafe(F.col("_pm"))
    counts = ~added & F.col("_s").isNotNull() & ~F.col("_s").eqNullSafe(F.col("_ps"))
    return rows.select("source_id", "media_key", "position", added.alias("added"), meta.alias("metadata_updated"), counts.alias("stats_updated"), (~added & ~meta & ~counts).alias("unchanged"))


def scan_diff_summary(flags: DataFrame, missing: DataFrame) -> DataFrame:
    """Per source: item_count, added, metadata_updated, stats_updated, unchanged, missing."""
    names = ("added", "metadata_updated", "stats_updated", "unchanged")
    counts = flags.groupBy("source_id").agg(F.count("*").alias("item_count"), *[F.count_if(F.col(n)).alias(n) for n in names])
    gone = missing.groupBy("source_id").agg(F.count("*").alias("missing"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("item_count", *names, "missing")]
    return counts.join(gone, "source_id", "full").select("source_id", *zero)


def last_rows(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by a sort-free aggregate."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*key, "_r.*")


def upsert(table: DataFrame, changes: DataFrame, key: list[str], keep: list[str] = ()) -> DataFrame:
    """Rows of ``changes`` replace those of the same key; ``keep`` columns stay as they were once known."""
    rest = [c for c in table.columns if c not in key]
    new = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in rest], F.lit(True).alias("_changed"))
    joined = table.join(new, key, "full")
    value = lambda c: F.coalesce(F.col(c), F.col(f"_new_{c}")) if c in keep else F.when(F.col("_changed"), F.col(f"_new_{c}")).otherwise(F.col(c))
    return joined.select(*key, *[value(c).alias(c) for c in rest])


def upsert_sources(sources: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert, or refresh url and title, by (platform, kind, source_key); a null title keeps the old one."""
    key = ["platform", "kind", "source_key"]
    new = incoming.select(*key, F.col("url").alias("_url"), F.col("title").alias("_title"))
    return sources.join(new, key, "full").select(*key, F.coalesce("_url", "url").alias("url"), F.coalesce("_title", "title").alias("title"))


def upsert_media(media: DataFrame, scan: DataFrame, fields: list[str]) -> DataFrame:
    """Insert, or overwrite the fields with those of the key's last scan row; the first source stays."""
    first = scan.groupBy("media_key").agg(F.min_by("source_id", F.struct("source_id", "position")).alias("source_id"))
    last = last_rows(scan.select("media_key", "source_id", "position", *fields), ["media_key"], ["source_id", "position"]).drop("source_id", "position")
    return upsert(media.select("media_key", "source_id", *fields), last.join(first, "media_key"), ["media_key"], keep=["source_id"])


def upsert_stats(stats: DataFrame, scan: DataFrame, columns: list[str]) -> DataFrame:
    """The last counts that are not all null replace a row whole, nulls included; all-null counts change nothing."""
    known = scan.filter(F.coalesce(*[F.col(c) for c in columns]).isNotNull()).select("media_key", "source_id", "position", *columns)
    last = last_rows(known, ["media_key"], ["source_id", "position"]).select("media_key", *columns)
    return upsert(stats.select("media_key", *columns), last, ["media_key"])


def upsert_membership(membership: DataFrame, scan: DataFrame, scans: DataFrame, seen_at: object) -> DataFrame:
    """Listed members are present at their last position; members missing from a complete scan are not; the rest stay."""
    key = ["source_id", "media_key"]
    now = scan.groupBy(*key).agg(F.max("position").alias("position")).withColumns({"is_present": F.lit(True), "last_seen": F.lit(seen_at)})
    out = upsert(membership.select(*key, "position", "is_present", "last_seen"), now, key)
    gone = missing_members(membership.filter("is_present").select(*key), scan, scans).withColumn("_gone", F.lit(True))
    return out.join(gone, key, "left").withColumn("is_present", F.col("is_present") & F.col("_gone").isNull()).drop("_gone")


def mark_refresh(refreshes: DataFrame, marks: DataFrame, media: DataFrame) -> DataFrame:
    """Upsert (media_key, group_name) with status and expires_at = fetched_at + ttl_seconds (0 or more); unknown media are left out, and
    ``unknown_marks`` lists them."""
    fine = marks.filter("ttl_seconds >= 0").join(media.select("media_key").distinct(), "media_key", "left_semi")
    new = fine.select("media_key", "group_name", "status", (F.col("fetched_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("ttl_seconds").cast("decimal(18,6)"))).cast(dict(refreshes.dtypes)["expires_at"]).alias("expires_at"))
    return upsert(refreshes.select("media_key", "group_name", "status", "expires_at"), new, ["media_key", "group_name"])


def unknown_marks(marks: DataFrame, media: DataFrame) -> DataFrame:
    return marks.join(media, "media_key", "left_anti")
