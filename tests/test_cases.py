"""Small cases with known answers, and comparisons with sequential models."""

import datetime
import random
import unicodedata
from collections import defaultdict, deque

import pytest
from marquee.functions import parse, similarity, text
from marquee.operators import catalog, duplicates, filters, index, jobs, ranking, reports
from marquee.sources import files
from marquee.streaming import streams
from pyspark.sql import functions as F


def one(spark, values, column, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_counts(spark):
    good = {"0": 0, "1000000": 1000000, "10L": 1000000, "1Cr": 10000000, "2.5Cr": 25000000, "1 m": 1000000, "500K": 500000, "1.5k": 1500, "3lakh": 300000, "2 lac": 200000, "1crore": 10000000, "1.000000000b": 1000000000, "9223372036854775807": 2**63 - 1}
    bad = ["", "-1", "1,000", "1e3", "1.5", "1.2345k", "9223372036854775808", "10000000000b", "k", "1.k", "1 kk", None]
    assert one(spark, [*good, *bad], parse.parse_count) == [*good.values(), *[None] * len(bad)]


def test_durations_dates_labels(spark):
    values = {"90": 90.0, "90s": 90.0, "5m": 300.0, "1.5h": 5400.0, "10:05": 605.0, "100:00": 6000.0, "1:02:03": 3723.0, "1:60": None, "1:60:00": None, "1:2:3:4": None, "x": None, "-5": None, "": None}
    assert one(spark, list(values), parse.parse_duration) == list(values.values())
    d = datetime.date(2024, 2, 29)
    assert one(spark, ["20240229", "2024-02-29", "20230229", "2024/02/29", None], parse.parse_date) == [d, d, None, None, None]
    assert one(spark, ["best", "worst", "1080", "720P", "exact:480", "100", "20000", "x"], lambda c: parse.parse_video_quality(c)["label"]) == ["best", "lowest", "1080p", "720p", "exact:480p", None, None, None]
    assert one(spark, ["0", "128", "320k", "31", "513", "192kbps"], lambda c: parse.parse_audio_quality(c)["label"]) == ["best", "128k", "320k", None, None, "192k"]


def test_text(spark):
    assert one(spark, ["STRAßE", None], text.fold) == ["strasse", None]
    assert one(spark, ["  a ", " \t", " x "], text.clean_text) == ["a", None, "x"]
    assert one(spark, ["The Official VIDEO of a Foo_bar foo 4K Äß"], text.title_tokens) == [["foo", "foo_bar", "of", "the", "äss"]]
    assert one(spark, ["a b~*é/+"], text.percent_encoded) == ["a%20b~%2A%C3%A9%2F%2B"]
    assert one(spark, ["Authorization: Bearer abc", "cookie=a; b\nnext", "x token = s3, y PASSWORD:z"], text.redacted) == ["Authorization: [REDACTED] abc", "cookie=[REDACTED]\nnext", "x token = [REDACTED], y PASSWORD:[REDACTED]"]


def test_sources(spark):
    table = {
        "@name": ("channel", "@name"), "youtube.com/@n/videos": ("channel_videos", "@n"), "https://m.youtube.com/channel/UC1/about": ("channel", "UC1"), "https://www.youtube.com/c/x/Shorts": ("channel_shorts", "x"),
        "https://youtu.be/abc?t=3": ("video", "abc"), "https://www.youtube.com/watch?list=L&v=q1": ("video", "q1"), "http://music.youtube.com/playlist?list=PL": ("playlist", "PL"), "https://youtube.com/live/zz": ("video", "zz"),
        "https://www.youtube.com/user/u/other": "subpage", "https://u:p@youtube.com/@a": "credentials", "https://example.com/@a": "host", "ftp://youtube.com/@a": "scheme", "https://youtu.be/": "no id", "https://www.youtube.com/watch": "no id",
        "https://www.youtube.com/shorts": "no id", "https://www.youtube.com/feed": "unrecognized", "  ": "empty", "https://www.youtube.com/": "unrecognized",
    }
    rows = catalog.resolve_sources(spark.createDataFrame([(u,) for u in table], "url string")).collect()
    assert {r.url: (r.kind, r.source_key) if r.reject is None else r.reject for r in rows} == table


def test_availability(spark):
    df = spark.createDataFrame([(None, None), ("PRIVATE ", None), ("removed", None), ("premium_only", None), ("private", "is_upcoming"), ("public", ""), ("", None)], "a string, l string")
    assert [r[0] for r in df.select(catalog.availability_action(F.col("a"), F.col("l"))).collect()] == ["download", "skip", "skip", "auth_required", "wait", "download", "download"]


def test_names(spark):
    rows = [("a/b: c??", "id1", datetime.date(2024, 1, 2)), ("CON", "k", None), ("  ..  ", "k", None), ("తెలుగు " * 60, "id2", None), ("é x - - y", "k", None), ("nul.txt", "k", None)]
    names = {r.title: r["name"] for r in catalog.output_names(spark.createDataFrame(rows, "title string, media_key string, upload_date date"), "mp4").collect()}
    got = [names[t] for t, _, _ in rows]
    assert got[0] == "2024-01-02 - a - b - c [id1].mp4" and got[1] == "_CON [k].mp4" and got[2] == "Untitled [k].mp4" and got[5] == "_nul.txt [k].mp4"
    assert len(got[3].encode()) <= 220 and got[3].endswith(" [id2].mp4") and unicodedata.is_normalized("NFC", got[4]) and got[4] == "é x - y [k].mp4"


def test_unknown_rules_and_errors(spark):
    df = spark.createDataFrame([("s", "a", 0, None, ""), ("s", "b", 1, 5, "X"), ("s", "c", 2, -1, None), ("s", "d", 3, 5, "y")], "source_id string, media_key string, position long, view_count long, channel string")
    keys = lambda d: [r.media_key for r in d.collect()]
    assert keys(df.filter(filters.metric_below("view_count", 10))) == ["b", "d"]
    assert keys(df.filter(filters.where_compare("views", "!=", 7) & filters.where_text("channel", "!~", "x"))) == ["d"]
    assert [r.media_key for r in ranking.ranked(df, "most-viewed").orderBy("rank").collect()] == ["b", "d", "c", "a"]
    assert [r.media_key for r in ranking.ranked(df, "least-viewed").orderBy("rank").collect()] == ["c", "b", "d", "a"]
    assert keys(ranking.select_last(df, 9)) == ["a", "b", "c", "d"] and keys(ranking.select_range(df, 3, None)) == ["c", "d"] and keys(ranking.select_range(df, 9, 12)) == []
    dated = df.withColumn("upload_date", F.lit(None).cast("date"))
    with pytest.raises(ValueError, match="a, b, c and more"):
        ranking.select_dated_strict(dated, 1, "latest")
    for bad in (lambda: ranking.select_first(df, 0), lambda: ranking.select_range(df, 5, 2), lambda: ranking.top_n_by_metric(df, "latest", 3, sort="oldest"), lambda: filters.metric_open_interval("v", 5, 5), lambda: filters.where_text("views", "~", "x"), lambda: ranking.parse_numbers("1,x")):
        with pytest.raises(ValueError):
            bad()
    assert ranking.parse_numbers("1,3,5:8,7-6") == [1, 3, 5, 6, 7, 8]


def test_scan_flags_against_sequential_model(spark):
    rng = random.Random(1)
    stub = lambda: (rng.choice("ab"), rng.choice([None, 1, 2]), rng.choice([None, 1]))
    old = [(f"k{i}", *stub()) for i in range(20)]
    scan = [(s, f"k{rng.randrange(30)}", p, *stub()) for s in ("s1", "s2") for p in range(40)]
    meta, stats = {k: t for k, t, *_ in old}, {k: v for k, _, *v in old if any(x is not None for x in v)}
    want = []
    for s, k, p, t, *v in sorted(scan, key=lambda r: (r[0], r[2])):
        added, changed = k not in meta, k in meta and meta[k] != t
        counted = k in meta and any(x is not None for x in v) and stats.get(k) != v
        want.append((s, k, p, added, changed, counted, not (added or changed or counted)))
        meta[k] = t
        if any(x is not None for x in v):
            stats[k] = v
    a = spark.createDataFrame(old, "media_key string, title string, view_count long, like_count long")
    b = spark.createDataFrame(scan, "source_id string, media_key string, position long, title string, view_count long, like_count long")
    assert sorted(tuple(r) for r in index.scan_row_flags(a, b, ["title"], ["view_count", "like_count"]).collect()) == sorted(want)
    assert {r.media_key: [r.view_count, r.like_count] for r in index.upsert_stats(a, b, ["view_count", "like_count"]).collect() if [r.view_count, r.like_count] != [None, None]} == stats


def test_candidates_against_sequential_model(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps", "video", "a"]
    rows = [(0, i, f"m{i}", " ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice([None, float(rng.randrange(60))])) for i in range(200)]
    tok = lambda t: frozenset(w for w in t.lower().split() if len(w) >= 2 and w not in text.STOP_WORDS)
    held, near, core, want = defaultdict(lambda: deque(maxlen=6)), defaultdict(lambda: deque(maxlen=3)), {}, set()
    for _, i, k, t, d in rows:
        own, found = tok(t), {}
        c = " ".join(sorted(own))
        for r in [core[c]] if c in core else []:
            found[r[1]] = r
        for w in own:
            found |= {r[1]: r for r in held[w]}
        if d is not None:
            for b in (-1, 0, 1):
                found |= {r[1]: r for r in near[int(d // 5) + b]}
        scored = []
        for r in found.values():
            if r[4] is None or d is None or abs(r[4] - d) <= max(5, 0.03 * max(r[4], d)):
                u = tok(r[3]) | own
                ratio = 0.5 if r[4] is None or d is None else 1.0 if max(r[4], d) == 0 else min(r[4], d) / max(r[4], d)
                scored.append((-(0.75 * (len(tok(r[3]) & own) / len(u) if u else 0) + 0.25 * ratio), r[2]))
        want |= {(x[1], k, round(-x[0], 9)) for x in sorted(scored)[:4]}
        row = (0, i, k, t, d)
        core |= {c: row} if c else {}
        for w in own:
            held[w].append(row)
        if d is not None:
            near[int(d // 5)].append(row)
    df = spark.createDataFrame(rows, "plan_id int, position long, media_key string, title string, duration_seconds double")
    got = duplicates.candidate_pairs(df, most=4, token_history=6, duration_history=3)
    assert {(r.left_media_key, r.right_media_key, round(r.metadata_score, 9)) for r in got.collect()} == want


def test_keepers_on_random_trees(spark):
    rng = random.Random(3)
    parent = {i: rng.randrange(i) if i and rng.random() < 0.9 else None for i in range(300)}
    parent |= {i: i - 1 for i in range(301, 500)} | {300: None}
    root = lambda i: i if parent[i] is None else root(parent[i])
    df = spark.createDataFrame(list(parent.items()), "media_key long, parent long")
    assert {r.media_key: r.keeper for r in duplicates.resolve_keepers(df).collect()} == {i: root(i) for i in parent}


def test_words_and_frames(spark):
    rng = random.Random(4)
    rows = [([rng.randrange(1 << 32) for _ in range(rng.randint(0, 9))], [rng.randrange(1 << 32) for _ in range(rng.randint(0, 9))]) for _ in range(60)] + [([5, 6, 7, 8], [9, 5, 6, 7, 8])]

    def model(a, b):
        if not a or not b:
            return None
        best = 0.0
        for s in range(-4, 5):
            x, y = a[max(0, s) :], b[max(0, -s) :]
            n = min(len(x), len(y))
            if n >= min(3, len(a), len(b)):
                best = max(best, sum(32 - (p ^ q).bit_count() for p, q in zip(x, y)) / (32 * n))
        return best

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a array<long>, b array<long>")
    got = [r[0] for r in df.orderBy("i").select(similarity.word_similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [pytest.approx(model(*r)) if model(*r) is not None else None for r in rows]
    frames = [[rng.randrange(256) for _ in range(16)] for _ in range(2)]
    edges = lambda f: [f[r * 4 + c] > f[r * 4 + c + 1] for r in range(4) for c in range(3)]
    a, b = frames
    want = 0.7 * (1 - sum(abs(x - y) for x, y in zip(a, b)) / (255 * 16)) + 0.3 * sum(x == y for x, y in zip(edges(a), edges(b))) / 12
    df = spark.createDataFrame([([a], [b, a])], "a array<array<int>>, b array<array<int>>")
    assert df.select(similarity.frame_similarity(F.col("a"), F.col("b"), 4, 4)).first()[0] == pytest.approx(want)


def test_pair_classes(spark):
    cases = [
        ((True, False, True, True, 0.95, None, 1.0), "likely_variant", 0.975), ((True, False, True, True, 0.5, None, 1.0), "unknown", 0.5), ((True, True, True, True, 0.95, 0.95, None), "same_media", 0.95), ((True, True, False, False, None, 0.92, 0.98), "same_media", 0.95),
        ((True, True, True, True, 0.95, 0.5, 0.99), "audio_variant", (0.95 + 0.5 + 0.99) / 3), ((True, True, True, True, 0.6, 0.8, 0.99), "likely_variant", (0.6 + 0.8 + 0.99) / 3), ((True, True, True, True, 0.5, 0.5, 1.0), "different", 0.5), ((True, True, True, True, None, None, 1.0), "unknown", 0.5),
        ((False, False, True, True, 0.93, None, None), "same_media", 0.93), ((False, False, True, True, 0.3, None, 1.0), "different", 0.7), ((False, False, True, True, None, None, 1.0), "likely_variant", 1.0), ((False, False, False, False, None, None, 1.0), "unknown", 0.25),
    ]
    df = spark.createDataFrame([(i, *c[0]) for i, c in enumerate(cases)], "i int, lv boolean, rv boolean, la boolean, ra boolean, a double, v double, d double")
    got = [r[0] for r in df.orderBy("i").select(similarity.classify_pair(*[F.col(c) for c in ("lv", "rv", "la", "ra", "a", "v", "d")])).collect()]
    assert [(g["class"], g["confidence"]) for g in got] == [(c, pytest.approx(x)) for _, c, x in cases]


def test_failures(spark):
    table = {"ERROR: Read timed out": ("network", True), "HTTP Error 503": ("server", True), "HTTP Error 429: Too Many": ("rate_limit", True), "Sign in to confirm your age": ("age_restricted", False), "Sign in to confirm you’re not a bot": ("bot_check", False), "Private   video": ("private", False),
             "HTTP Error 403: Forbidden": ("forbidden", False), "This video is unavailable": ("unavailable", False), "No space left on device": ("disk_space", True), "weird": ("unknown", False), "code 15035": ("unknown", False), "Premiere will begin in 5": ("live_not_ready", True)}
    rows = reports.classify_failures(spark.createDataFrame([(m,) for m in table], "message string")).collect()
    assert {r.message: (r.category, r.retryable) for r in rows} == table
    assert one(spark, [1, 2, 3, 7, 9], jobs.retry_delay, "long") == [2.0, 4.0, 8.0, 120.0, 120.0]


def test_snapshots_and_archive(spark, tmp_path):
    items = spark.createDataFrame([("p", i, f"k{i}") for i in range(2500)], "plan string, position long, media_key string")
    h = lambda d: jobs.selection_hash(d, "plan", ["media_key"]).first().content_hash
    assert h(items) == h(items.repartition(7)) != h(items.withColumn("position", 2499 - F.col("position")))
    base = f"file://{tmp_path}"
    files.write_selection_snapshot(items, "plan", ["media_key"], f"{base}/snap")
    assert files.read_selection_snapshot(spark, f"{base}/snap", "plan", ["media_key"]).count() == 2500
    items.filter("position = 3").withColumn("media_key", F.lit("forged")).write.mode("append").parquet(f"{base}/snap/items")
    assert files.read_selection_snapshot(spark, f"{base}/snap", "plan", ["media_key"]).count() == 0
    keys = spark.createDataFrame([("yt", "a"), ("yt", "b"), ("yt", "a")], "extractor string, media_key string")
    assert files.append_archive(f"{base}/archive", keys.limit(1)).count() == 1 and files.append_archive(f"{base}/archive", keys).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x [id1].mp4").write_bytes(b"abc")
    got = files.hash_files(spark, f"{base}/f").first()
    assert got.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and files.hash_files(spark, f"{base}/f", most_bytes=2, chunk_bytes=2).first() == got
    assert [tuple(r) for r in files.newest_output_per_item(files.list_files(spark, f"{base}/f"), "mp4").collect()] == [("id1", "x [id1].mp4")]


def test_job_rules(spark):
    js = spark.createDataFrame([(1, "running"), (2, "paused"), (3, "cancelled"), (4, "planned")], "job_id long, status string")
    items = spark.createDataFrame([(1, 10, "completed"), (1, 11, "pending"), (2, 20, "failed_final"), (2, 21, "completed"), (3, 30, "pending")], "job_id long, item_id long, status string")
    assert {r.job_id: r.status for r in reports.derive_job_status(js, items).collect()} == {1: "running", 2: "completed_with_failures", 3: "cancelled", 4: "completed"}
    with pytest.raises(ValueError):
        jobs.assert_unique_items(items, ["job_id"])
    jobs.assert_unique_items(items, ["item_id"])


def test_streams_go_on_from_checkpoints(spark, tmp_path):
    base = f"file://{tmp_path}"
    keys = lambda *x: spark.createDataFrame([(v, datetime.datetime(2024, 1, 1)) for v in x], "value string, ts timestamp").coalesce(1)
    for rows in (("a", "b", "a"), ("b", "c")):
        keys(*rows).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("value string, ts timestamp").parquet(f"{base}/in")
        streams.stream_first_seen(stream, f"{base}/out", f"{base}/cp")
        streams.stream_first_seen(stream, f"{base}/out2", f"{base}/cp2", within="1 day")
    for out in ("out", "out2"):
        assert sorted(r.value for r in spark.read.parquet(f"{base}/{out}").collect()) == ["a", "b", "c"]


def test_spread_ranks_equal_windows(spark):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), f"m{i}", i, rng.choice([None, *range(9)]), rng.choice(["x", "Y", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "source_id string, media_key string, position long, view_count long, title string")
    for mode in ("most-viewed", "title-za", "source"):
        both = [sorted((r.media_key, r["rank"]) for r in ranking.ranked(df, mode, spread=s).collect()) for s in (False, True)]
        assert both[0] == both[1]
        last = {r.media_key: r["rank"] for r in ranking.select_last(df.filter("source_id = 'hot'"), 7, mode).collect()}
        whole = {r.media_key: r["rank"] for r in ranking.ranked(df.filter("source_id = 'hot'"), mode).collect()}
        assert last == {k: v for k, v in whole.items() if v > len(whole) - 7}


def test_stored_tables_can_be_dropped(spark):
    from marquee.sources import tables

    tables.drop_stored(spark)
    df = tables.stored(spark.range(5))
    assert df.count() == 5 and tables.drop_stored(spark) == 1 and tables.drop_stored(spark) == 0


def test_long_listing(spark):
    """One document of 20,000 entries: no row carries the list that it stands in."""
    entries = ",".join(f'{{"id":"v{i}","title":"t"}}' for i in range(20_000))
    df = spark.createDataFrame([("s", f'{{"title":"T","channel":"C","entries":[{entries}]}}')], "source_id string, document string")
    rows = catalog.explode_listings(df)
    r = rows.agg(F.count("*"), F.max("position"), F.min("channel")).first()
    assert tuple(r) == (20_000, 19_999, "C")


def test_full_case_folding(spark):
    texts = ["Straße", "ΟΔΟΣ", "ſtill", "oﬃce ﬁt", "ŉ", "ΐ", "plain Text", "İstanbul", "ΣΑΣ ς", None]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(text.fold(F.col("t")).alias("f")).collect()]
    assert got == [t and t.casefold() for t in texts]


def test_cut_at_bytes(spark):
    texts = ["abcdef", "aé漢😀", "漢字漢字", "😀😀", ""]
    rows = [(t, n, t.encode()[:n].decode("utf-8", "ignore")) for t in texts for n in range(9)]
    df = spark.createDataFrame(rows, "t string, n int, want string")
    assert df.filter(~catalog._cut(F.col("t"), F.col("n")).eqNullSafe(F.col("want"))).count() == 0


def test_composed_names(spark):
    df = spark.createDataFrame([("k1", "Cafe\u0301: a", None), ("k2", "Plain: a", datetime.date(2020, 1, 2)), ("k3", None, None)], "media_key string, title string, upload_date date")
    got = {r.media_key: r["name"] for r in catalog.output_names(df, "mp4").collect()}
    assert got["k1"] == "Caf\u00e9 - a [k1].mp4" and got["k2"] == "2020-01-02 - Plain - a [k2].mp4"


def test_every_failure_has_a_message(spark):
    assert set(reports.USER_MESSAGES) == {name for name, _, _ in reports.FAILURE_MARKS} | {"unknown"}


def test_recent_rows_of_hot_groups(spark):
    """A group with half of the rows spreads over partitions, also where these hold fewer rows than the frame."""
    from pyspark.sql.window import Window

    from marquee.operators.ordering import recent

    rows = [("hot" if i % 2 else f"g{i % 7}", i, None if i % 11 == 0 else i * 10) for i in range(600)] + [(None, i, i) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, at long, v long")
    for history, parts in ((1, 9), (64, 16), (64, 150), (5, 1), (1000, 12)):
        w = Window.partitionBy("g").orderBy("at").rowsBetween(-history, -1)
        want = sorted(map(str, df.withColumn("held", F.collect_list("v").over(w)).collect()))
        assert sorted(map(str, recent(df, ["at"], ["g"], "v", history, partitions=parts).collect())) == want
    dealt = df.repartitionByRange(16, "g", "at").groupBy(F.spark_partition_id().alias("p"), "g").count()
    assert dealt.agg(F.max("count")).first()[0] < 100 < df.filter("g = 'hot'").count()
    assert recent(df.limit(0), ["at"], ["g"], "v", 3).count() == 0


def test_hot_token_candidates(spark):
    """One token in every title, one title and one duration for half of them."""
    from marquee.operators import duplicates as d

    items = spark.createDataFrame([(1, i, f"k{i}", "same song" if i % 2 else f"song {100 + i}", 100.0 if i % 2 else float(i)) for i in range(300)], "plan_id long, position long, media_key string, title string, duration_seconds double")
    held = {(r.position, r.earlier) for r in d.recent_token_holders(items, 3).collect()}
    assert held == {(i, j) for i in range(300) for j in range(max(0, i - 3), i)} | {(i, j) for i in range(1, 300, 2) for j in range(1, i, 2) if i - j <= 6}
    assert {(r.position, r.earlier) for r in d.previous_same_title(items).collect()} == {(i, i - 2) for i in range(3, 300, 2)}
    buckets = {i: (20 if i % 2 else i // 5) for i in range(300)}
    want = {(i, j) for i in range(300) for b in (-1, 0, 1) for j in [k for k in range(i) if buckets[k] == buckets[i] + b][-2:]}
    assert {(r.position, r.earlier) for r in d.recent_duration_neighbors(items, 2).collect()} == want
