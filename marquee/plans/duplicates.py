"""Queries over duplicates, fingerprints and files."""

import uuid

from pyspark.sql import functions as F

from marquee.functions import similarity as x
from marquee.operators import duplicates as d
from marquee.operators.screening import CandidateScreener
from marquee.plans.registry import ORACLE_SQL, query
from marquee.sources import files as s
from marquee.sources.tables import shared_dir

# --- candidates over titles -----------------------------------------------------------------------------------------
_TOK = r"list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(title, '[\p{L}\p{N}_]+'), lambda x: lower(x)), lambda x: length(x) >= 2 AND x NOT IN ('official','video','audio','lyrics','lyric','music','hd','4k','1080p','remastered','remaster'))))"
_T = f"tt AS (SELECT plan_id, position, media_key, duration_seconds, {_TOK} AS tk, array_to_string({_TOK}, ' ') AS core FROM titles)"
_W4 = "SELECT plan_id, position, unnest(h) AS earlier FROM (SELECT plan_id, position, list(position) OVER (PARTITION BY plan_id, token ORDER BY position ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING) AS h FROM (SELECT plan_id, position, unnest(tk) AS token FROM tt) u) w"
_W6 = "SELECT plan_id, position, earlier FROM (SELECT plan_id, position, lag(position) OVER (PARTITION BY plan_id, core ORDER BY position) AS earlier FROM tt WHERE core <> '') l WHERE earlier IS NOT NULL"
_W5 = """SELECT plan_id, position, earlier FROM (SELECT p.plan_id, p.position, b.position AS earlier, row_number() OVER (PARTITION BY p.plan_id, p.position, b.b ORDER BY b.position DESC) AS n
 FROM (SELECT plan_id, position, CAST(floor(duration_seconds / 5) AS BIGINT) AS b FROM tt WHERE duration_seconds >= 0) p JOIN (SELECT plan_id, position, CAST(floor(duration_seconds / 5) AS BIGINT) AS b FROM tt WHERE duration_seconds >= 0) b
 ON b.plan_id = p.plan_id AND b.b BETWEEN p.b - 1 AND p.b + 1 AND b.position < p.position) q WHERE n <= 8"""
_ALL = f"SELECT DISTINCT plan_id, position, earlier FROM ({_W4} UNION ALL {_W6} UNION ALL {_W5}) a"
_SCORED = f"""SELECT c.plan_id, l.media_key AS left_media_key, r.media_key AS right_media_key, l.duration_seconds AS ld, r.duration_seconds AS rd,
 0.75 * CASE WHEN len(l.tk) + len(r.tk) = 0 THEN 0 ELSE len(list_intersect(l.tk, r.tk))::DOUBLE / len(list_distinct(l.tk || r.tk)) END + 0.25 * CASE WHEN l.duration_seconds IS NULL OR r.duration_seconds IS NULL THEN 0.5 WHEN greatest(l.duration_seconds, r.duration_seconds) = 0 THEN 1 ELSE least(l.duration_seconds, r.duration_seconds) / greatest(l.duration_seconds, r.duration_seconds) END AS score
 FROM ({_ALL}) c JOIN tt l ON l.plan_id = c.plan_id AND l.position = c.earlier JOIN tt r ON r.plan_id = c.plan_id AND r.position = c.position"""
_FIT = "(ld IS NULL OR rd IS NULL OR abs(ld - rd) <= greatest(5, 0.03 * greatest(ld, rd)))"
_PAIRS = f"SELECT plan_id, left_media_key, right_media_key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, right_media_key ORDER BY score DESC, left_media_key) AS rank FROM ({_SCORED}) s WHERE {_FIT}) t WHERE rank <= 12"


query("w4_recent_token_holders", f"WITH {_T} {_W4}")(lambda v: d.recent_token_holders(v.titles))
query("w5_recent_duration_neighbors", f"WITH {_T} {_W5}")(lambda v: d.recent_duration_neighbors(v.titles))
query("w6_previous_same_title", f"WITH {_T} {_W6}")(lambda v: d.previous_same_title(v.titles))
query("u3_union_candidates", f"WITH {_T} {_ALL}")(lambda v: d.union_candidates(d.recent_token_holders(v.titles), d.previous_same_title(v.titles), d.recent_duration_neighbors(v.titles)).select("plan_id", "position", "earlier"))
query("j6_candidate_pairs", f"WITH {_T} SELECT plan_id, left_media_key, right_media_key, round(score, 6) AS score FROM ({_PAIRS}) p")(lambda v: d.candidate_pairs(v.titles).select("plan_id", "left_media_key", "right_media_key", F.round("metadata_score", 6).alias("score")))


def _screened(v):
    """Three batches of each plan, one after another."""
    screener = CandidateScreener(v.spark, f"{shared_dir(v.spark)}/screen-{uuid.uuid4().hex}", buckets=16)
    third = v.titles.agg(F.max("position")).first()[0] // 3 + 1
    cuts = [screener.consider(v.titles.filter((F.col("position") >= k * third) & (F.col("position") < (k + 1) * third)), k) for k in range(3)]
    return cuts[0].unionByName(cuts[1]).unionByName(cuts[2]).select("plan_id", "left_media_key", "right_media_key", F.round("metadata_score", 6).alias("score"))


query("j6_screened_in_batches")(_screened)
ORACLE_SQL["j6_screened_in_batches"] = ORACLE_SQL["j6_candidate_pairs"]
query("w7_top_candidates", f"WITH {_T} SELECT plan_id, right_media_key, rank, round(score, 6) AS score FROM ({_PAIRS}) p WHERE rank <= 3")(lambda v: d.candidate_pairs(v.titles, most=3).select("plan_id", "right_media_key", "rank", F.round("metadata_score", 6).alias("score")))
_ADJ = "SELECT *, lag(duration_seconds) OVER (PARTITION BY plan_id ORDER BY position) AS ld, lag(tk) OVER (PARTITION BY plan_id ORDER BY position) AS lt FROM tt"


def _adjacent(v):
    t = v.titles.withColumn("tk", d.title_tokens(F.col("title")))
    last = d.recent(t, ["position"], ["plan_id"], F.struct(F.col("duration_seconds").alias("ld"), F.col("tk").alias("lt")), 1)
    return last.filter("size(held) > 0").select("media_key", "duration_seconds", "tk", F.col("held")[0]["ld"].alias("ld"), F.col("held")[0]["lt"].alias("lt"))


query("j7_duration_compatible", f"WITH {_T} SELECT media_key, (ld IS NULL OR duration_seconds IS NULL OR abs(ld - duration_seconds) <= greatest(5, 0.03 * greatest(ld, duration_seconds))) AS fits FROM ({_ADJ}) a WHERE lt IS NOT NULL")(lambda v: _adjacent(v).select("media_key", x.duration_compatible(F.col("ld"), F.col("duration_seconds")).alias("fits")))
query(
    "x4_metadata_score",
    f"""WITH {_T} SELECT media_key, round(0.75 * CASE WHEN len(lt) + len(tk) = 0 THEN 0 ELSE len(list_intersect(lt, tk))::DOUBLE / len(list_distinct(lt || tk)) END
 + 0.25 * CASE WHEN ld IS NULL OR duration_seconds IS NULL THEN 0.5 WHEN greatest(ld, duration_seconds) = 0 THEN 1 ELSE least(ld, duration_seconds) / greatest(ld, duration_seconds) END, 6) AS score FROM ({_ADJ}) a WHERE lt IS NOT NULL""",
)(lambda v: _adjacent(v).select("media_key", F.round(x.metadata_score(F.col("lt"), F.col("tk"), F.col("ld"), F.col("duration_seconds")), 6).alias("score")))


# --- fingerprints ---------------------------------------------------------------------------------------------------
def _prints(v, scale=1000000):
    """Words and one 8 by 8 frame from each vector; a small scale makes words alike."""
    e = F.col("embedding")
    words = F.transform(e, lambda y: F.floor((y.cast("double") + 1) * scale))
    frame = F.transform(e, lambda y: F.least(F.lit(255), F.greatest(F.lit(0), F.floor((y.cast("double") + 0.5) * 255))).cast("int"))
    return v.prints.select("media_key", "label", "duration_seconds", "has_audio", "has_video", F.when(F.col("has_audio"), words).alias("words"), F.when(F.col("has_video"), F.array(frame)).alias("frames"))


def _compared(v, scale=1000000):
    return d.compare_pairs(d.fingerprint_pairs(v.print_pairs, _prints(v, scale)), 8, 8)


_P = """fp AS (SELECT media_key, label, duration_seconds, has_audio, has_video, CASE WHEN has_audio THEN list_transform(embedding, lambda e: CAST(floor((CAST(e AS DOUBLE) + 1) * 1000000) AS BIGINT)) END AS words,
 CASE WHEN has_video THEN list_transform(embedding, lambda e: CAST(least(255, greatest(0, floor((CAST(e AS DOUBLE) + 0.5) * 255))) AS BIGINT)) END AS frame FROM prints),
pj AS (SELECT p.*, l.words AS lw, r.words AS rw, l.frame AS lf, r.frame AS rf, l.duration_seconds AS ld, r.duration_seconds AS rd, l.has_audio AS la, r.has_audio AS ra, l.has_video AS lv, r.has_video AS rv FROM print_pairs p JOIN fp l ON l.media_key = left_media_key JOIN fp r ON r.media_key = right_media_key),
sh AS (SELECT left_media_key, right_media_key, s, greatest(0, s) AS a, greatest(0, -s) AS b, least(len(lw) - greatest(0, s), len(rw) - greatest(0, -s)) AS n, lw, rw FROM pj, (SELECT unnest(range(-4, 5)) AS s) k WHERE lw IS NOT NULL AND rw IS NOT NULL),
aud AS (SELECT left_media_key, right_media_key, max(1 - list_sum(list_transform(range(1, n + 1), lambda i: bit_count(xor(lw[a + i], rw[b + i]))))::DOUBLE / (32 * n)) AS audio FROM sh WHERE n >= 3 GROUP BY 1, 2),
sim AS (SELECT pj.*, audio, CASE WHEN lf IS NOT NULL AND rf IS NOT NULL THEN 0.7 * (1 - list_sum(list_transform(range(1, 65), lambda i: abs(lf[i] - rf[i])))::DOUBLE / (255.0 * 64))
 + 0.3 * (len(list_filter(range(1, 64), lambda i: i % 8 <> 0 AND (lf[i] > lf[i + 1]) = (rf[i] > rf[i + 1])))::DOUBLE / 56) END AS video, CASE WHEN greatest(ld, rd) = 0 THEN 1 ELSE least(ld, rd) / greatest(ld, rd) END AS dur FROM pj LEFT JOIN aud USING (left_media_key, right_media_key))"""
_CLASS = """CASE WHEN lv <> rv THEN CASE WHEN audio >= 0.9 AND dur >= 0.97 THEN 'likely_variant' ELSE 'unknown' END
 WHEN lv AND rv THEN CASE WHEN video >= 0.9 AND dur >= 0.97 AND la = ra AND (NOT la OR audio >= 0.9) THEN 'same_media' WHEN audio >= 0.9 AND video < 0.72 AND dur >= 0.97 THEN 'audio_variant' WHEN audio >= 0.9 OR video >= 0.72 THEN 'likely_variant'
  WHEN coalesce(audio < 0.55, TRUE) AND coalesce(video < 0.55, TRUE) AND (audio IS NOT NULL OR video IS NOT NULL) THEN 'different' ELSE 'unknown' END
 WHEN la AND ra THEN CASE WHEN audio >= 0.9 AND dur >= 0.97 THEN 'same_media' WHEN audio < 0.55 THEN 'different' ELSE 'likely_variant' END ELSE 'unknown' END"""
_MEAN = lambda *v: "(" + " + ".join(f"coalesce(least(1, greatest(0, {x})), 0)" for x in v) + ") / nullif(" + " + ".join(f"CASE WHEN {x} IS NULL THEN 0 ELSE 1 END" for x in v) + ", 0)"
_CONF = f"""coalesce(CASE WHEN c = 'likely_variant' AND lv <> rv THEN {_MEAN('audio', 'dur')} WHEN c = 'unknown' AND NOT (lv <> rv) AND NOT (lv AND rv) THEN 0.25 WHEN c = 'unknown' THEN 0.5
 WHEN c = 'same_media' AND lv THEN {_MEAN('video', 'audio', 'dur')} WHEN c = 'audio_variant' THEN {_MEAN('audio', '1 - video', 'dur')} WHEN c = 'likely_variant' AND lv THEN {_MEAN('audio', 'video', 'dur')}
 WHEN c = 'different' AND lv THEN {_MEAN('1 - audio', '1 - video')} WHEN c = 'different' THEN {_MEAN('1 - audio')} ELSE {_MEAN('audio', 'dur')} END, 0)"""
_KEYS = "left_media_key, right_media_key"
query("j8_fingerprint_pairs", f"WITH {_P} SELECT {_KEYS}, ld AS l_duration_seconds, rd AS r_duration_seconds FROM pj")(
    lambda v: d.fingerprint_pairs(v.print_pairs, _prints(v)).select("left_media_key", "right_media_key", "l_duration_seconds", "r_duration_seconds")
)
query("j8_pairs_without_prints", f"SELECT {_KEYS} FROM print_pairs WHERE left_media_key LIKE '%5' OR right_media_key LIKE '%5'")(lambda v: d.pairs_without_prints(v.print_pairs, v.prints.filter("media_key NOT LIKE '%5'")))
query("j9_fingerprints_needed", "SELECT media_key FROM prints WHERE vec_id % 4 <> 1")(lambda v: d.fingerprints_needed(v.prints.select("media_key"), v.prints.selectExpr("media_key", "'av' AS kind", "'v1' AS algorithm", "CASE WHEN vec_id % 4 = 1 THEN 'full' ELSE 'head' END AS scope"), "av", "v1", "full"))
query("x1_word_similarity", f"WITH {_P} SELECT {_KEYS}, round(audio, 6) AS audio FROM sim")(lambda v: _compared(v).select("left_media_key", "right_media_key", F.round("audio", 6).alias("audio")))
query("x2_frame_similarity", f"WITH {_P} SELECT {_KEYS}, round(video, 6) AS video FROM sim")(lambda v: _compared(v).select("left_media_key", "right_media_key", F.round("video", 6).alias("video")))
query("x3_duration_similarity", f"WITH {_P} SELECT {_KEYS}, round(dur, 6) AS duration FROM sim")(lambda v: _compared(v).select("left_media_key", "right_media_key", F.round("duration", 6).alias("duration")))
query("x5_classify_pairs", f"WITH {_P} SELECT {_KEYS}, {_CLASS} AS class FROM sim")(lambda v: _compared(v).select("left_media_key", "right_media_key", "class"))
query("x6_pair_confidence", f"WITH {_P} SELECT {_KEYS}, round({_CONF}, 6) AS confidence FROM (SELECT *, {_CLASS} AS c FROM sim) t")(lambda v: _compared(v).select("left_media_key", "right_media_key", F.round("confidence", 6).alias("confidence")))
query("x7_skip_policy", f"WITH {_P} SELECT {_KEYS}, CASE c WHEN 'same_media' THEN {_CONF} >= 0.9 WHEN 'audio_variant' THEN audio >= 0.9 AND dur >= 0.97 ELSE FALSE END AS skip FROM (SELECT *, {_CLASS} AS c FROM sim) t")(
    lambda v: _compared(v).select("left_media_key", "right_media_key", x.should_skip(F.col("class"), F.col("confidence"), F.col("audio"), F.col("duration"), "mp3", "audio").alias("skip"))
)
query("x8_pair_evidence", f"WITH {_P} SELECT sha256(left_media_key || '|' || right_media_key) AS group_id, {_CLASS} AS class, CASE r WHEN 0 THEN left_media_key ELSE right_media_key END AS media_key, CASE r WHEN 0 THEN 'reference' ELSE 'candidate' END AS role FROM sim, (VALUES (0), (1)) t(r)")(lambda v: d.pair_evidence(_compared(v)).select("group_id", "class", "media_key", "role"))
query("b6_upsert_fingerprints", "SELECT media_key, 'av' AS kind, 'v1' AS algorithm, 'full' AS scope, CASE WHEN (vec_id % 2 = 1 OR vec_id % 3 = 0) AND vec_id % 5 <> 0 THEN vec_id + 1000 ELSE vec_id END AS seq FROM prints WHERE vec_id % 2 = 0 OR vec_id % 5 <> 0")(
    lambda v: d.upsert_fingerprints(v.prints.filter("vec_id % 2 = 0").selectExpr("media_key", "'av' AS kind", "'v1' AS algorithm", "'full' AS scope", "vec_id AS seq"), v.prints.filter("vec_id % 2 = 1 OR vec_id % 3 = 0").selectExpr("media_key", "'av' AS kind", "'v1' AS algorithm", "'full' AS scope", "vec_id + 1000 AS seq"), v.prints.filter("vec_id % 5 <> 0"))
)
#: Rows whose text is broken.
_BAD = "vec_id % 10 IN (1, 2, 3, 4)"


def _texts(v):
    p = _prints(v).withColumn("vec_id", F.expr("CAST(substring(media_key, 2) AS BIGINT)")).withColumn("frames", F.transform("frames", lambda f: F.unhex(F.array_join(F.transform(f, lambda q: F.lpad(F.hex(q), 2, "0")), ""))))
    text = s.fingerprint_to_text(p)
    broken = F.when(F.col("vec_id") % 10 == 1, F.regexp_replace(text, '"has_audio":(true|false)', '"has_audio":"yes"')).when(F.col("vec_id") % 10 == 2, F.substring(text, 1, 40)).when(F.col("vec_id") % 10 == 3, F.regexp_replace(text, r'"duration_seconds":', '"duration_seconds":-')).when(F.col("vec_id") % 10 == 4, F.regexp_replace(text, r'"audio_words":(null|\[)', '"audio_words":[-1,'))
    return p.select("vec_id", F.coalesce(broken, text).alias("value"))


query("s10_fingerprint_codec", f"SELECT vec_id, NOT ({_BAD}) AS valid, CASE WHEN NOT ({_BAD}) THEN CASE WHEN has_audio THEN CAST(len(embedding) AS BIGINT) ELSE 0 END END AS n_words FROM prints")(
    lambda v: s.fingerprint_from_text(_texts(v), "value").select("vec_id", "valid", F.when(F.col("valid"), F.coalesce(F.size("p.audio_words"), F.lit(0)).cast("long")).alias("n_words")).withColumn("n_words", F.when(F.col("n_words") < 0, 0).otherwise(F.col("n_words")))
)

# --- files ----------------------------------------------------------------------------------------------------------
_HASHED = "SELECT position, path, sha256(content) AS sha256 FROM files"


def _hashed(v):
    return s.hash_texts(v.files.select("position", "path", "content"))


def _hashed_files(v, by_source=False):
    """A hundred documents a file, written and hashed as files."""
    path = f"{shared_dir(v.spark)}/files-{uuid.uuid4().hex}"
    texts = v.files.select(F.floor(F.col("position") / 100).alias("bucket"), "position", F.coalesce("content", F.lit("")).alias("value"))
    texts.repartition("bucket").sortWithinPartitions("bucket", "position").select("bucket", "value").write.partitionBy("bucket").text(path)
    bucket = F.regexp_extract("path", "bucket=([0-9]+)", 1).cast("long").alias("bucket")
    if by_source:
        v.spark.dataSource.register(s.FileHashes)
        return v.spark.read.format("file_hashes").option("glob", "*.txt").option("split_bytes", 1 << 20).load(path).select(bucket, "size", "sha256")
    return s.hash_files(v.spark, path, "*.txt").select(bucket, "size", "sha256")


query("s11_hash_files", "SELECT CAST(floor(position / 100) AS BIGINT) AS bucket, CAST(sum(strlen(coalesce(content, '')) + 1) AS BIGINT) AS size, sha256(string_agg(coalesce(content, ''), chr(10) ORDER BY position) || chr(10)) AS sha256 FROM files GROUP BY 1")(_hashed_files)
query("s11_file_hashes_source")(lambda v: _hashed_files(v, True))
ORACLE_SQL["s11_file_hashes_source"] = ORACLE_SQL["s11_hash_files"]
query("s11_hash_texts", _HASHED)(_hashed)
query("w10_keep_first_exact", f"SELECT position, path, first_value(path) OVER (PARTITION BY sha256 ORDER BY position, path) AS keeper FROM ({_HASHED}) h")(lambda v: d.keep_first_exact(_hashed(v)).select("position", "path", "keeper"))
query("s12_newest_output_per_item", "SELECT media_key, CASE WHEN position % 4 = 0 THEN 'old [' || media_key || '].mp4' ELSE 'big [' || media_key || '].mkv' END AS name FROM media")(
    lambda v: s.newest_output_per_item(
        v.media.select("media_key", "position", F.explode(F.expr("array(named_struct('p', 'old', 's', 'mp4', 'm', 1, 'z', 5), named_struct('p', 'big', 's', 'mkv', 'm', 2, 'z', 9), named_struct('p', 'small', 's', 'mkv', 'm', 2, 'z', 3), named_struct('p', 'new', 's', 'json', 'm', 7, 'z', 1))")).alias("f"))
        .filter("NOT (position % 4 <> 0 AND f.s = 'mp4')").select(F.concat("f.p", F.lit(" ["), "media_key", F.lit("]."), "f.s").alias("name"), F.col("f.m").alias("mtime"), F.col("f.z").alias("size")),
        "MP4",
    )
)
query("s13_append_archive", "SELECT DISTINCT 'youtube ' || CAST(item_id AS VARCHAR) AS value FROM phase_events")(lambda v: _archive(v))


def _archive(v):
    path, keys = f"{shared_dir(v.spark)}/archive-{uuid.uuid4().hex}", v.phase_events.selectExpr("'youtube' AS extractor", "CAST(item_id AS STRING) AS media_key")
    s.append_archive(path, keys.filter("CAST(media_key AS BIGINT) % 2 = 0"))
    return s.append_archive(path, keys)


_SNAP = ["media_key", "title", "view_count"]
query("s14_selection_snapshot", "SELECT source_id, media_key, position FROM media")(lambda v: _snapshot(v))


def _snapshot(v):
    path = f"{shared_dir(v.spark)}/snapshot-{uuid.uuid4().hex}"
    s.write_selection_snapshot(v.media, "source_id", _SNAP, path)
    return s.read_selection_snapshot(v.spark, path, "source_id", _SNAP).select("source_id", "media_key", "position")


def _keys_added(v):
    """An archive after half of the keys, then all of them, then the same batch again; what the second batch added, and all keys."""
    archive = s.KeyArchive(v.spark, f"{shared_dir(v.spark)}/keys-{uuid.uuid4().hex}", 32)
    keys = v.phase_events.selectExpr("'youtube ' || item_id AS value", "item_id")
    archive.add(keys.filter("item_id % 2 = 0"), 0)
    return archive.add(keys, 1), archive.add(keys, 1), archive.keys()


query("s13_archive_in_batches", "SELECT DISTINCT 'youtube ' || CAST(item_id AS VARCHAR) AS value FROM phase_events")(lambda v: _keys_added(v)[2])
query("s13_keys_added", "SELECT DISTINCT 'youtube ' || CAST(item_id AS VARCHAR) AS value FROM phase_events WHERE item_id % 2 = 1")(lambda v: _keys_added(v)[1])


def _damage(v):
    """One row of a source gone, one forged, one too many."""
    path = f"{shared_dir(v.spark)}/snapshot-{uuid.uuid4().hex}"
    s.write_selection_snapshot(v.media, "source_id", _SNAP, path)
    forged = v.media.filter("NOT (source_id = 'src1' AND position = 5)").withColumn("title", F.expr("CASE WHEN source_id = 'src2' AND position = 0 THEN 'forged' ELSE title END"))
    more = v.media.filter("source_id = 'src3' AND position = 1").withColumn("position", F.col("position") + 1000000)
    return s.snapshot_damage(v.spark, path, "source_id", _SNAP, forged.unionByName(more))


query(
    "v4_snapshot_damage",
    "SELECT source_id, position, CASE source_id WHEN 'src1' THEN 'missing' ELSE 'changed' END AS problem FROM media WHERE (source_id = 'src1' AND position = 5) OR (source_id = 'src2' AND position = 0) UNION ALL SELECT source_id, position + 1000000 AS position, 'added' AS problem FROM media WHERE source_id = 'src3' AND position = 1",
)(_damage)
query(
    "s10_fingerprint_rejects",
    "SELECT vec_id, CASE vec_id % 10 WHEN 1 THEN 'stream flag' WHEN 2 THEN 'no JSON object' WHEN 3 THEN 'duration' ELSE CASE WHEN has_audio THEN 'words' ELSE 'no JSON object' END END AS reason FROM prints WHERE vec_id % 10 IN (1, 2, 3, 4)",
)(lambda v: s.fingerprint_from_text(_texts(v), "value").filter("NOT valid").select("vec_id", "reason"))
_PROFILE = ["platform", "media_key", "output_format", "quality"]
_LATEST = "(SELECT media_key, path FROM (SELECT *, row_number() OVER (PARTITION BY media_key ORDER BY download_id DESC) AS n FROM downloads WHERE status = 'completed') t WHERE n = 1) l JOIN present_files p ON p.path = l.path"


def _wanted(v):
    return v.files.selectExpr("'youtube' AS platform", "media_key", "'mp4' AS output_format", "'best' AS quality")


query("j4_already_have", f"SELECT media_key FROM files WHERE media_key IN (SELECT media_key FROM {_LATEST})")(lambda v: d.already_have(_wanted(v), v.downloads, v.present_files, _PROFILE).select("media_key"))
query("d1_skip_known_profiles", f"SELECT media_key FROM files WHERE media_key NOT IN (SELECT media_key FROM {_LATEST})")(lambda v: d.skip_known_profiles(_wanted(v), v.downloads, v.present_files, _PROFILE).select("media_key"))
query("j13_stale_records", "SELECT download_id, CASE WHEN status = 'completed' AND path NOT IN (SELECT path FROM present_files) THEN 'stale' ELSE status END AS status FROM downloads")(lambda v: d.stale_records(v.downloads, v.present_files).select("download_id", "status"))


query("j13_stale_file_rows", "SELECT download_id, 'h' || path AS sha256 FROM downloads WHERE NOT (status = 'completed' AND path NOT IN (SELECT path FROM present_files))")(
    lambda v: d.present_records(v.downloads.selectExpr("download_id", "'h' || path AS sha256"), d.stale_records(v.downloads, v.present_files))
)


def _registry(v):
    return _hashed(v).filter("position % 5 = 1").selectExpr("sha256", "path", "position AS file_id")


_REG = f"(SELECT sha256, arg_max(path, position) AS keeper FROM ({_HASHED}) h WHERE position % 5 = 1 AND path IN (SELECT path FROM present_files) GROUP BY sha256)"
query("j5_exact_file_matches", f"SELECT n.position, n.path, g.keeper FROM ({_HASHED}) n JOIN {_REG} g USING (sha256) WHERE n.position % 5 <> 1")(lambda v: d.exact_file_matches(_hashed(v).filter("position % 5 <> 1"), _registry(v), v.present_files))
query("d2_exact_duplicates", f"SELECT n.position, n.path, coalesce(g.keeper, first_value(n.path) OVER (PARTITION BY n.sha256 ORDER BY n.position, n.path)) AS keeper FROM ({_HASHED}) n LEFT JOIN {_REG} g USING (sha256) WHERE n.position % 5 <> 1")(
    lambda v: d.exact_duplicates(_hashed(v).filter("position % 5 <> 1"), _registry(v), v.present_files)
)



def _parents(v):
    """Pairs close enough in this data: the nearest earlier item whose video is at least 0.74 similar."""
    near = _compared(v).filter("video >= 0.74").groupBy("right_media_key").agg(F.min_by("left_media_key", "rank").alias("parent"))
    return v.prints.select("media_key").join(near.withColumnRenamed("right_media_key", "media_key"), "media_key", "left")


_PARENT = "SELECT m.media_key, arg_min(left_media_key, rank) FILTER (video >= 0.74) AS parent FROM prints m LEFT JOIN sim ON right_media_key = m.media_key GROUP BY m.media_key"
query(
    "d3_smart_duplicates",
    f"WITH {_P.replace('1000000', '4')} SELECT right_media_key, arg_min(left_media_key, rank) AS left_media_key FROM (SELECT *, {_CLASS} AS c FROM sim) t WHERE CASE c WHEN 'same_media' THEN {_CONF} >= 0.9 WHEN 'audio_variant' THEN audio >= 0.9 AND dur >= 0.97 ELSE FALSE END AND left_media_key NOT LIKE '%3' GROUP BY right_media_key",
)(lambda v: d.smart_duplicates(v.print_pairs, _compared(v, 4), v.prints.filter("media_key NOT LIKE '%3'"), "mp3", "audio"))
query(
    "d4_resolve_keepers",
    f"""WITH RECURSIVE {_P}, par AS ({_PARENT}), up(media_key, keeper) AS (SELECT media_key, media_key FROM par WHERE parent IS NULL UNION ALL SELECT par.media_key, up.keeper FROM par JOIN up ON par.parent = up.media_key) SELECT media_key, keeper FROM up""",
)(lambda v: d.resolve_keepers(_parents(v)))
query(
    "d5_register_outcomes",
    f"""WITH RECURSIVE {_P}, par AS ({_PARENT}), up(media_key, keeper) AS (SELECT media_key, media_key FROM par WHERE parent IS NULL UNION ALL SELECT par.media_key, up.keeper FROM par JOIN up ON par.parent = up.media_key),
 own AS (SELECT media_key, '/f/' || media_key AS path FROM prints WHERE vec_id % 8 <> 0)
 SELECT u.media_key, CASE WHEN o.path IS NOT NULL AND k.path IS NOT NULL AND u.keeper <> u.media_key THEN 'skipped_duplicate' ELSE 'completed' END AS status, CASE WHEN o.path IS NOT NULL AND k.path IS NOT NULL AND u.keeper <> u.media_key THEN k.path ELSE o.path END AS output_path
 FROM up u LEFT JOIN own o ON o.media_key = u.media_key LEFT JOIN own k ON k.media_key = u.keeper""",
)(lambda v: d.register_outcomes(v.prints.select("media_key"), d.resolve_keepers(_parents(v)), v.prints.filter("vec_id % 8 <> 0").selectExpr("media_key", "'/f/' || media_key AS path")))
