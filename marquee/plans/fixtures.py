"""Views of the catalogue's shape over the tables at hand. The SQL runs in Spark and in any ANSI engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS: dict[str, str] = {}

VIEWS["media"] = """SELECT 'src' || CAST(o_custkey % 20 AS STRING) AS source_id, 'm' || CAST(o_orderkey AS STRING) AS media_key,
 CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS BIGINT) AS position,
 o_orderpriority || ' Order ' || CAST(o_orderkey % 97 AS STRING) AS title,
 CASE WHEN o_orderkey % 13 <> 0 THEN CAST(o_orderkey % 4000 AS DOUBLE) END AS duration_seconds,
 CASE WHEN o_orderkey % 11 <> 0 THEN CAST(o_orderdate AS DATE) END AS upload_date,
 CASE WHEN o_orderkey % 7 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS view_count,
 CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) END AS like_count,
 CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'Ch' || CAST(o_custkey % 25 AS STRING) END AS channel,
 CASE o_orderkey % 8 WHEN 0 THEN 'private' WHEN 1 THEN 'unlisted' WHEN 2 THEN 'scheduled' WHEN 3 THEN 'members_only'
  WHEN 4 THEN 'deleted' WHEN 5 THEN 'unknown' ELSE 'public' END AS availability,
 CASE o_orderstatus WHEN 'F' THEN 'video' WHEN 'O' THEN 'short' ELSE 'stream' END AS media_type FROM orders"""

VIEWS["titles"] = """SELECT CAST(p_partkey % 5 AS BIGINT) AS plan_id, p_partkey AS position, 'p' || CAST(p_partkey AS STRING) AS media_key,
 p_name || CASE p_partkey % 4 WHEN 0 THEN ' Official Video' WHEN 1 THEN ' Lyrics' WHEN 2 THEN ' live' ELSE ' ' || p_brand END AS title,
 CASE WHEN p_partkey % 9 <> 0 THEN CAST(p_size * 10 + p_partkey % 3 AS DOUBLE) END AS duration_seconds FROM part"""

VIEWS["jobs"] = """SELECT c_custkey AS job_id, c_nationkey AS source_id, CAST(floor(c_acctbal * 100) AS BIGINT) AS updated_seq,
 CASE c_custkey % 4 WHEN 0 THEN 'planned' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' ELSE 'cancelled' END AS status FROM customer"""

VIEWS["job_items"] = """SELECT o_custkey AS job_id, o_orderkey AS item_id,
 CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS position,
 CASE o_orderkey % 10 WHEN 0 THEN 'pending' WHEN 1 THEN 'downloading' WHEN 2 THEN 'postprocessing' WHEN 3 THEN 'verifying'
  WHEN 4 THEN 'skipped_duplicate' WHEN 5 THEN 'skipped_unavailable' WHEN 6 THEN 'failed_retryable'
  WHEN 7 THEN 'failed_final' WHEN 8 THEN 'cancelled' ELSE 'completed' END AS status,
 CAST(o_orderkey % 6 AS BIGINT) AS attempts, CAST(o_orderdate AS DATE) AS retry_after_at,
 CASE o_orderkey % 3 WHEN 0 THEN 'private: ' || o_orderpriority WHEN 1 THEN 'drm: ' || o_orderpriority ELSE '' END AS last_error FROM orders"""

VIEWS["failures"] = """SELECT l_orderkey AS item_id, CAST(l_linenumber AS BIGINT) AS seq, l_linestatus = 'F' AS is_open,
 CASE l_linenumber % 3 WHEN 0 THEN 'network' WHEN 1 THEN 'server' ELSE '' END AS category,
 CASE l_returnflag WHEN 'A' THEN 'Read timed out' WHEN 'N' THEN 'HTTP Error 503: Service Unavailable' ELSE '' END AS message FROM lineitem"""

VIEWS["files"] = """SELECT doc_id AS position, source || '/' || CAST(doc_id AS STRING) AS path, text AS content, 'd' || CAST(doc_id AS STRING) AS media_key FROM documents"""

VIEWS["urls"] = """SELECT url FROM pages UNION ALL
 SELECT CASE doc_id % 8 WHEN 0 THEN 'https://www.youtube.com/watch?v=d' WHEN 1 THEN 'https://youtu.be/d'
  WHEN 2 THEN 'https://www.youtube.com/playlist?list=d' WHEN 3 THEN '@d' WHEN 4 THEN 'https://youtube.com/shorts/d'
  WHEN 5 THEN 'youtube.com/@d' WHEN 6 THEN 'https://www.youtube.com/channel/d' ELSE 'ftp://youtube.com/d' END || CAST(doc_id % 50 AS STRING) AS url FROM documents"""

VIEWS["scan1"] = """SELECT * FROM media WHERE position % 10 <> 0"""
VIEWS["scan2"] = """SELECT source_id, media_key, position, CASE WHEN position % 4 = 0 THEN title || ' v2' ELSE title END AS title, duration_seconds, upload_date,
 CASE WHEN position % 3 = 0 THEN view_count + 1 ELSE view_count END AS view_count, like_count, channel, availability, media_type FROM media WHERE position % 10 <> 1
 UNION ALL SELECT source_id, media_key, position + 1000000 AS position, title || ' again' AS title, duration_seconds, upload_date, view_count, like_count, channel, availability, media_type
 FROM media WHERE position % 50 = 2"""
VIEWS["scans"] = """SELECT DISTINCT source_id, source_id <> 'src0' AS complete FROM media"""

VIEWS["phase_events"] = """SELECT CAST(user_id % 10 AS BIGINT) AS job_id, CAST(user_id AS BIGINT) AS item_id, ts, CAST(event_id AS BIGINT) AS event_id,
 CASE event_type WHEN 'signup' THEN 'preparing' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'processing' WHEN 'purchase' THEN 'converting' ELSE 'finished' END AS phase FROM events"""

VIEWS["entries"] = """SELECT 'src' || CAST(o_custkey % 20 AS STRING) AS source_id,
 CAST(row_number() OVER (PARTITION BY o_custkey % 20 ORDER BY o_orderkey) - 1 AS BIGINT) AS pos,
 CASE WHEN o_orderkey % 10 = 0 THEN 'null' WHEN o_orderkey % 15 = 1 THEN '"text"' ELSE
  '{' || CASE WHEN o_orderkey % 20 = 3 THEN '' WHEN o_orderkey % 20 = 4 THEN '"id":"  ",' ELSE '"id":" m' || CAST(o_orderkey % 5000 AS STRING) || '",' END
  || CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE '"title":" T' || CAST(o_orderkey % 97 AS STRING) || ' ",' END
  || CASE WHEN o_orderkey % 4 = 0 THEN '"url":"https://x.example/' || CAST(o_orderkey AS STRING) || '",' ELSE '"url":"m/1",' END
  || CASE WHEN o_orderkey % 7 = 0 THEN '"view_count":-5,' WHEN o_orderkey % 7 = 1 THEN '"view_count":"many",' ELSE '"view_count":' || CAST(o_orderkey % 900 AS STRING) || ',' END
  || CASE WHEN o_orderkey % 9 = 0 THEN '"uploader":"U","channel":"",' WHEN o_orderkey % 9 = 1 THEN '"channel":"Own",' ELSE '' END
  || CASE WHEN o_orderkey % 12 = 0 THEN '"n_entries":7,' WHEN o_orderkey % 12 = 5 THEN '"playlist_count":0,"n_entries":9,' ELSE '' END
  || '"duration":' || CAST(o_orderkey % 500 AS STRING) || '.5,"live_status":"' || CASE o_orderkey % 5 WHEN 0 THEN 'was_live' ELSE 'not_live' END || '"}' END AS entry FROM orders"""
VIEWS["listings"] = """SELECT source_id, '{"title":" List ' || source_id || ' ","channel":"Parent","playlist_count":' || CASE WHEN length(source_id) = 4 THEN '-1' ELSE '99' END
 || ',"n_entries":12,"entries":[' || string_agg(entry, ',' ORDER BY pos) || ']}' AS document FROM entries GROUP BY source_id"""

VIEWS["refreshes"] = """SELECT media_key, 'statistics' AS group_name, CASE WHEN position % 9 = 0 THEN 'failed' ELSE 'ok' END AS status, CAST(upload_date + INTERVAL 30 DAY AS DATE) AS expires_at FROM media WHERE position % 4 <> 0"""

VIEWS["prints"] = """SELECT CAST(vec_id AS BIGINT) AS vec_id, 'v' || CAST(vec_id AS STRING) AS media_key, CAST(label AS BIGINT) AS label, vec_id % 7 <> 0 AS has_audio, vec_id % 3 <> 0 AS has_video, CAST(60 + vec_id % 5 AS DOUBLE) AS duration_seconds, embedding FROM embeddings"""

VIEWS["print_rows"] = """SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS n FROM prints"""
VIEWS["print_pairs"] = """SELECT 'v' || CAST(a.vec_id AS STRING) AS left_media_key, 'v' || CAST(b.vec_id AS STRING) AS right_media_key, b.k AS rank FROM print_rows a JOIN (SELECT vec_id, label, n - k AS m, k FROM print_rows CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7), (8), (9), (10), (11), (12)) t(k)) b ON a.label = b.label AND a.n = b.m"""

VIEWS["downloads"] = """SELECT position AS download_id, 'youtube' AS platform, media_key, 'mp4' AS output_format, 'best' AS quality, path, CASE WHEN position % 5 = 0 THEN 'failed' ELSE 'completed' END AS status FROM files
 UNION ALL SELECT position + 10000000, 'youtube', media_key, 'mp4', 'best', path || '.new', 'completed' FROM files WHERE position % 4 = 0"""
VIEWS["present_files"] = """SELECT path FROM files WHERE position % 6 <> 0 UNION ALL SELECT path || '.new' FROM files WHERE position % 8 = 0"""

VIEWS["statuses"] = """SELECT CAST(user_id AS BIGINT) AS item_id, CAST(event_id AS BIGINT) AS seq,
 CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'downloading' WHEN 'click' THEN 'postprocessing' WHEN 'purchase' THEN 'completed' ELSE 'failed_retryable' END AS status FROM events"""

VIEWS["attempt_logs"] = """SELECT CAST(floor(event_id / 4) AS BIGINT) AS attempt_id, CAST(event_id AS BIGINT) AS line_no,
 CASE event_id % 9 WHEN 0 THEN 'WARNING: signature solving failed' WHEN 1 THEN 'Missing PO Token for client' WHEN 2 THEN 'Failed to decrypt with DPAPI' ELSE 'fetching page' END AS line FROM events"""
#: Messages with the categories that they have.
MESSAGES = (
    ("ERROR: HTTP Error 403: Forbidden", "forbidden"), ("Please Sign in to confirm you''re not a bot", "bot_check"), ("Video unavailable", "unavailable"), ("  Read  timed\n out ", "network"), ("HTTP Error 429: Too Many Requests", "rate_limit"),
    ("Sorry, this is a PRIVATE video", "private"), ("error 503 again", "server"), ("[Errno 28] No space left on device", "disk_space"), ("Premiere will begin shortly", "live_not_ready"), ("members-only content", "auth_required"),
    ("geo-restricted", "geo_blocked"), ("odd", "unknown"), ("OSError: [Errno 36] File name too long", "filename_too_long"), ("this stream is DRM protected", "drm"), ("The VIDEO has been removed by its owner", "deleted"),
    ("age-restricted: an account is needed", "age_restricted"), ("Could not copy Chrome cookie database", "cookie_access"), ("a PO Token is needed", "po_token_required"), ("nsig: challenge solving failed", "extractor"), ("502 Bad Gateway", "server"),
    ("port 15030 is closed", "unknown"), ("Connection reset by peer", "network"), ("Join this channel to watch", "auth_required"), ("This live event is SCHEDULED for tomorrow", "live_not_ready"), ("The content is no longer available", "unavailable"), ("403 forbidden, then 429", "rate_limit"),
)
VIEWS["failure_texts"] = "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{m}', '{c}')" for k, (m, c) in enumerate(MESSAGES)) + ") t(k, message, expected)"
VIEWS["attempts"] = f"SELECT CAST(event_id AS BIGINT) AS attempt_id, message, expected FROM events JOIN failure_texts ON k = event_id % {len(MESSAGES)}"


def needed(sql: str) -> list[str]:
    """Names of the views that a query needs, in the order in which they build on each other."""
    seen: list[str] = []

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in seen and re.search(rf"\b{name}\b", text):
                visit(VIEWS[name])
                if name not in seen:
                    seen.append(name)

    visit(sql)
    return [n for n in VIEWS if n in seen]


def with_views(sql: str) -> str:
    """``sql`` with the views that it names before it, as common table expressions."""
    names = needed(sql)
    if not names:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    for start in ("WITH RECURSIVE ", "WITH "):
        if sql.lstrip().upper().startswith(start):
            return f"{start}{head}, {sql.lstrip()[len(start):]}"
    return f"WITH {head} {sql}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the tables in ``sf_dir``."""
    sql = with_views(f"SELECT * FROM {name}")
    for t in TABLES:
        if re.search(rf"\bFROM {t}\b", sql):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"source_{t}")
            sql = re.sub(rf"\bFROM {t}\b", f"FROM source_{t}", sql)
    return spark.sql(sql.replace("string_agg(entry, ',' ORDER BY pos)", "string_agg(entry, ',') WITHIN GROUP (ORDER BY pos)"))
