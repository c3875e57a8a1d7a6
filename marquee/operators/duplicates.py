"""Duplicates in layers: known profiles, equal files, and candidate pairs judged by fingerprints. Earlier items keep, later ones follow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.functions import similarity as x
from marquee.functions.text import title_tokens
from marquee.operators.ordering import before, recent
from marquee.sources.tables import stored

PLAN = "plan_id"


def recent_token_holders(items: DataFrame, history: int = 64) -> DataFrame:
    """(plan, position, earlier): the last ``history`` earlier items with a token, for every token of an item, however many hold it."""
    tokens = items.select(PLAN, "position", F.explode(title_tokens(F.col("title"))).alias("token"))
    return recent(tokens, ["position"], [PLAN, "token"], "position", history).select(PLAN, "position", F.explode("held").alias("earlier"))


def previous_same_title(items: DataFrame) -> DataFrame:
    """(plan, position, earlier): the last earlier item with the same normalized title."""
    core = items.select(PLAN, "position", F.array_join(title_tokens(F.col("title")), " ").alias("core")).filter("core <> ''")
    return recent(core, ["position"], [PLAN, "core"], "position", 1).select(PLAN, "position", F.explode("held").alias("earlier"))


def recent_duration_neighbors(items: DataFrame, history: int = 8, seconds: float = 5.0) -> DataFrame:
    """(plan, position, earlier): the last ``history`` earlier items in each of the buckets next to and of an item's duration.

    Each probe counts the bucket's items before it among both, dealt by range, and fetches them by number; no range join.
    """
    known = items.filter("duration_seconds >= 0").select(PLAN, "position", F.floor(F.col("duration_seconds") / seconds).alias("b"))
    build = known.select(PLAN, "b", "position", F.lit(1).cast("long").alias("is_item"))
    probe = known.select(PLAN, F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), "position", F.lit(0).cast("long").alias("is_item"))
    both = before(build.unionByName(probe), [PLAN, "b", "position", "is_item"], [PLAN, "b"], "is_item", out="n")
    numbered = both.filter("is_item = 1").select(PLAN, "b", (F.col("n") + 1).alias("number"), F.col("position").alias("earlier"))
    wanted = both.filter("is_item = 0 AND n > 0").select(PLAN, "b", "position", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("n") - history + 1), F.col("n"))).alias("number"))
    return wanted.join(numbered, [PLAN, "b", "number"]).select(PLAN, "position", "earlier")


def union_candidates(*found: DataFrame) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def candidate_pairs(items: DataFrame, most: int = 12, token_history: int = 64, duration_history: int = 8, seconds: float = 5.0) -> DataFrame:
    """(plan, left_media_key, right_media_key, metadata_score, rank): for each item its ``most`` best plausible earlier items.

    Three blocking keys with bounded histories propose pairs of positions; titles and durations join them afterwards.
    """
    return scored_candidates(items, union_candidates(recent_token_holders(items, token_history), previous_same_title(items), recent_duration_neighbors(items, duration_history, seconds)), most)


def scored_candidates(items: DataFrame, pairs: DataFrame, most: int = 12) -> DataFrame:
    """The ``most`` best plausible pairs of each item, from pairs of positions (plan, position, earlier)."""
    side = lambda p, at: items.select(PLAN, F.col("position").alias(at), F.col("media_key").alias(f"{p}_media_key"), title_tokens(F.col("title")).alias(f"{p}_t"), F.col("duration_seconds").alias(f"{p}_d"))
    joined = pairs.join(side("right", "position"), [PLAN, "position"]).join(side("left", "earlier"), [PLAN, "earlier"])
    fits = joined.filter(x.duration_compatible(F.col("left_d"), F.col("right_d")))
    scored = fits.withColumn("metadata_score", x.metadata_score(F.col("left_t"), F.col("right_t"), F.col("left_d"), F.col("right_d")))
    return top_candidates(scored, most).select(PLAN, "left_media_key", "right_media_key", "metadata_score", "rank")


def top_candidates(scored: DataFrame, most: int = 12) -> DataFrame:
    """The best of each item by score, then key."""
    w = Window.partitionBy(PLAN, "right_media_key").orderBy(F.col("metadata_score").desc(), "left_media_key")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= most)


def fingerprint_pairs(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """Pairs with both sides' fingerprints (l_*, r_*); ``pairs_without_prints`` has the others."""
    side = lambda p, key: prints.select(*[F.col(c).alias(key if c == "media_key" else f"{p}_{c}") for c in prints.columns])
    return pairs.join(side("l", "left_media_key"), "left_media_key").join(side("r", "right_media_key"), "right_media_key")


def pairs_without_prints(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    has = prints.select("media_key").distinct()
    left = pairs.join(has.withColumnRenamed("media_key", "left_media_key"), "left_media_key", "left_anti").select("left_media_key", "right_media_key")
    right = pairs.join(has.withColumnRenamed("media_key", "right_media_key"), "right_media_key", "left_anti").select("left_media_key", "right_media_key")
    return left.unionByName(right).distinct()


def fingerprints_needed(items: DataFrame, cached: DataFrame, kind: str, algorithm: str, scope: str, refresh: bool = False) -> DataFrame:
    if refresh:
        return items
    return items.join(cached.filter((F.col("kind") == kind) & (F.col("algorithm") == algorithm) & (F.col("scope") == scope)), "media_key", "left_anti")


def upsert_fingerprints(old: DataFrame, new: DataFrame, media: DataFrame) -> DataFrame:
    """One row per (media_key, kind, algorithm, scope), the greatest ``seq`` wins; unknown media are left out."""
    key = ["media_key", "kind", "algorithm", "scope"]
    rows = old.unionByName(new.join(media.select("media_key").distinct(), "media_key", "left_semi").select(old.columns))
    rest = [c for c in old.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*key, "_r.*")


def compare_pairs(joined: DataFrame, width: int = 16, height: int = 16, thresholds: x.Thresholds = x.Thresholds()) -> DataFrame:
    """Similarities, class and confidence of pairs with l_ and r_ fingerprints (words, frames, duration_seconds, has_audio, has_video)."""
    out = joined.withColumns({"audio": x.word_similarity(F.col("l_words"), F.col("r_words")), "video": x.frame_similarity(F.col("l_frames"), F.col("r_frames"), width, height), "duration": x.duration_similarity(F.col("l_duration_seconds"), F.col("r_duration_seconds"))})
    kind = x.classify_pair(F.col("l_has_video"), F.col("r_has_video"), F.col("l_has_audio"), F.col("r_has_audio"), F.col("audio"), F.col("video"), F.col("duration"), thresholds)
    return out.withColumn("_k", kind).withColumns({"class": F.col("_k.class"), "confidence": F.col("_k.confidence")}).drop("_k")


def pair_evidence(compared: DataFrame) -> DataFrame:
    """Two rows per pair: group_id (a hash of its keys), class, confidence, evidence as JSON with nulls, media_key and role."""
    evidence = F.to_json(F.struct(F.round("audio", 6).alias("audio_similarity"), F.round("duration", 6).alias("duration_similarity"), F.round("video", 6).alias("video_similarity")), {"ignoreNullFields": "false"})
    members = F.explode(F.array(F.struct(F.col("left_media_key").alias("media_key"), F.lit("reference").alias("role")), F.struct(F.col("right_media_key").alias("media_key"), F.lit("candidate").alias("role"))))
    return compared.select(F.sha2(F.concat_ws("|", "left_media_key", "right_media_key"), 256).alias("group_id"), "class", "confidence", evidence.alias("evidence_json"), members.alias("m")).select("group_id", "class", "confidence", "evidence_json", "m.*")


def latest_completed(downloads: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in downloads.columns if c not in keys]
    return downloads.filter("status = 'completed'").groupBy(*keys).agg(F.max_by(F.struct(*rest), "download_id").alias("_r")).select(*keys, "_r.*")


def already_have(items: DataFrame, downloads: DataFrame, present: DataFrame, profile: list[str]) -> DataFrame:
    """Items whose profile's newest completed record has a file that is there."""
    return items.join(latest_completed(downloads, profile).join(present, "path", "left_semi"), profile, "left_semi")


def skip_known_profiles(items: DataFrame, downloads: DataFrame, present: DataFrame, profile: list[str]) -> DataFrame:
    return items.join(latest_completed(downloads, profile).join(present, "path", "left_semi"), profile, "left_anti")


def stale_records(downloads: DataFrame, present: DataFrame) -> DataFrame:
    """Completed records whose file is gone become stale; all others stay."""
    gone = downloads.filter("status = 'completed'").join(present, "path", "left_anti").select("download_id", F.lit(True).alias("_gone"))
    return downloads.join(gone, "download_id", "left").withColumn("status", F.when(F.col("_gone"), "stale").otherwise(F.col("status"))).drop("_gone")


def present_records(files: DataFrame, downloads: DataFrame) -> DataFrame:
    """File rows (with download_id) whose record ``stale_records`` has not made stale."""
    return files.join(downloads.filter("status = 'stale'").select("download_id"), "download_id", "left_anti")


def exact_file_matches(new: DataFrame, registry: DataFrame, present: DataFrame) -> DataFrame:
    """(position, path, keeper): new files whose hash a registered file has that is there; its newest (file_id) keeps."""
    best = registry.join(present, "path", "left_semi").groupBy("sha256").agg(F.max_by("path", "file_id").alias("keeper"))
    return new.join(best, "sha256").select("position", "path", "keeper")


def keep_first_exact(files: DataFrame) -> DataFrame:
    """(position, path, sha256, keeper): the first file of each hash keeps. One aggregate and a join, so that a hash that many files
    share is summed before it is shuffled, and its join can be split."""
    first = files.groupBy("sha256").agg(F.min_by("path", F.struct("position", "path")).alias("keeper"))
    return files.join(first, "sha256").select("position", "path", "sha256", "keeper")


def exact_duplicates(files: DataFrame, registry: DataFrame, present: DataFrame, mode: str = "safe") -> DataFrame:
    """(position, path, keeper): registered copies first, then the first new file; mode off keeps all."""
    if mode == "off":
        return files.select("position", "path", F.col("path").alias("keeper"))
    old = exact_file_matches(files, registry, present).select("position", F.col("keeper").alias("_old"))
    return keep_first_exact(files).join(old, "position", "left").select("position", "path", F.coalesce("_old", "keeper").alias("keeper"))


def smart_duplicates(pairs: DataFrame, compared: DataFrame, registered: DataFrame, output_format: str, mode: str) -> DataFrame:
    """(right_media_key, left_media_key): the first candidate by rank that is registered and close enough."""
    skip = x.should_skip(F.col("class"), F.col("confidence"), F.col("audio"), F.col("duration"), output_format, mode)
    fine = compared.filter(skip).select("left_media_key", "right_media_key").join(registered.select(F.col("media_key").alias("left_media_key")).distinct(), "left_media_key", "left_semi")
    ranked = pairs.select("left_media_key", "right_media_key", "rank").join(fine, ["left_media_key", "right_media_key"])
    return ranked.groupBy("right_media_key").agg(F.min_by("left_media_key", "rank").alias("left_media_key"))


def resolve_keepers(parents: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(media_key, keeper): the root of each item's tree, from (media_key, parent), parent null or itself for roots. Pointers double in
    every round, and each round is stored, so a chain of n items takes log n rounds."""
    now = stored(parents.select("media_key", F.coalesce("parent", "media_key").alias("keeper")))
    for _ in range(most_rounds):
        up = now.select(F.col("media_key").alias("keeper"), F.col("keeper").alias("_up"))
        new = stored(now.join(up, "keeper", "left").select("media_key", F.coalesce("_up", "keeper").alias("keeper"), (F.coalesce("_up", "keeper") != F.col("keeper")).alias("_moved")))
        now = new.drop("_moved")
        if new.filter("_moved").isEmpty():
            return now
    raise RuntimeError("parents form a cycle")


def register_outcomes(items: DataFrame, keepers: DataFrame, paths: DataFrame) -> DataFrame:
    """Per item: completed with its own path (null without a file), or skipped_duplicate with its keeper's."""
    own = paths.select("media_key", "path")
    joined = items.join(keepers, "media_key", "left").join(own, "media_key", "left").join(own.select(F.col("media_key").alias("keeper"), F.col("path").alias("_kept")), "keeper", "left")
    follows = F.coalesce(F.col("path").isNotNull() & (F.col("keeper") != F.col("media_key")) & F.col("_kept").isNotNull(), F.lit(False))
    return joined.select("media_key", F.when(follows, "skipped_duplicate").otherwise("completed").alias("status"), F.when(follows, F.col("_kept")).otherwise(F.col("path")).alias("output_path"))
