"""Bucketed tables, and what is built on them: index rounds, phase counts and candidate screening, batch by batch."""

import datetime
import random
from pathlib import Path

import pytest
from marquee.operators.duplicates import candidate_pairs
from marquee.operators.index import upsert
from marquee.operators.reports import phase_counts
from marquee.operators.screening import CandidateScreener
from marquee.sources.buckets import BucketedTable, Conflict
from marquee.streaming import streams
from pyspark.sql import functions as F


def sizes(path):
    """Bytes of each version's data files."""
    return {v.name: sum(f.stat().st_size for f in v.rglob("*.parquet")) for v in sorted(Path(path, "data").iterdir())}


def put(old, changes):
    return upsert(old, changes, ["k"])


@pytest.fixture
def table(spark, tmp_path):
    t = BucketedTable(spark, f"file://{tmp_path}/t", ["k"], spark.range(1).selectExpr("id AS k", "'' AS v").schema, 32)
    t.merge(spark.range(5000).selectExpr("id AS k", "repeat(cast(id AS string), 9) AS v"), put, 0)
    return t


def test_writes_follow_the_changes(spark, tmp_path, table):
    table.merge(spark.createDataFrame([(7, "seven"), (9000, "new")], "k long, v string"), put, 1)
    whole, part = sizes(tmp_path / "t").values()
    assert part < whole / 8
    rows = {r.k: r.v for r in table.read().collect()}
    assert len(rows) == 5001 and rows[7] == "seven" and rows[9000] == "new" and rows[8] == "8" * 9
    assert sum(b["rows"] for b in table.manifest()["buckets"].values()) == 5001


def test_repeated_batch_changes_nothing(spark, tmp_path, table):
    before, files = table.manifest(), sizes(tmp_path / "t")
    assert table.merge(spark.createDataFrame([(7, "x")], "k long, v string"), put, 0) == before and sizes(tmp_path / "t") == files


def test_unfinished_version_is_written_again(spark, tmp_path, table):
    table.spark.range(3).write.parquet(f"{table.path}/data/v{2:012d}")  # data without a manifest
    table.merge(spark.createDataFrame([(7, "seven")], "k long, v string"), put, 1)
    assert table.read().count() == 5000 and {r.k: r.v for r in table.read().collect()}[7] == "seven"


def test_two_writers_of_a_version(spark, table):
    with pytest.raises(Conflict):
        table._put(table.manifest())


def test_old_versions_go(spark, tmp_path, table):
    kept = table.manifest()
    for n in range(1, 5):
        table.merge(spark.createDataFrame([(7, f"v{n}")], "k long, v string"), put, n)
    assert table.versions() == [4, 5]
    assert {r.v for r in table.read(manifest=table.before(4)).filter("k = 7").collect()} == {"v3"}
    folders = {f"{b.parent.name}/{b.name}" for b in Path(tmp_path, "t/data").glob("v*/_bucket=*")}
    assert folders == {b["folder"][5:] for m in map(table.manifest, (4, 5)) for b in m["buckets"].values()} and kept["version"] == 1


def test_rows_may_go_and_keys_may_not_change(spark, table):
    table.merge(spark.createDataFrame([(7, None)], "k long, v string"), lambda old, changes: old.join(changes.select("k"), "k", "left_anti"), 1)
    assert table.read().count() == 4999
    with pytest.raises(ValueError):
        table.merge(spark.createDataFrame([(8, None)], "k long, v string"), lambda old, _: old.withColumn("k", F.col("k") + 1), 2)
    assert table.merge(spark.createDataFrame([], "k long, v string"), put, 3)["batch"] == 3 and table.read().count() == 4999


def scan(spark, rows, complete=True):
    day = datetime.date(2024, 1, 1)
    return spark.createDataFrame(
        [(s, k, p, complete, t, 1.0, day, "c", "public", "video", v, None) for s, k, p, t, v in rows],
        "source_id string, media_key string, position long, complete boolean, title string, duration_seconds double, upload_date date, channel string, availability string, media_type string, view_count long, like_count long",
    )


def test_index_rounds(spark, tmp_path):
    base = f"file://{tmp_path}/index"
    first = scan(spark, [("s", f"k{i}", i, f"t{i}", i) for i in range(2000)] + [("u", "k1", 0, "t1", 1)])
    media, members = streams.index_tables(spark, base, first, 64)
    assert {r.source_id: r.added for r in streams.apply_scan(media, members, first, 0).collect()} == {"s": 2000, "u": 0}
    second = scan(spark, [("u", "k1", 3, "other", 1), ("u", "new", 4, "n", None)])
    audits = [sorted(map(tuple, streams.apply_scan(media, members, second, 1).collect())) for _ in range(2)]
    assert audits[0] == audits[1] and media.manifest()["version"] == 2
    assert media.read().count() == 2001 and members.read().count() == 2002
    assert media.read().filter("media_key = 'k1'").select("title", "view_count").first() == ("other", 1)
    whole, part = sizes(tmp_path / "index/media").values()
    assert part < whole / 8
    streams.apply_scan(media, members, scan(spark, [("u", "new", 4, "n", 5)]), 2)
    assert {(r.media_key, r.is_present, r.last_seen) for r in members.read().filter("source_id = 'u'").collect()} == {("k1", False, 1), ("new", True, 2)}
    streams.apply_scan(media, members, scan(spark, [("u", "k1", 4, "n", 5)], complete=False), 3)
    assert members.read().filter("is_present AND source_id = 'u'").count() == 2


def test_phase_counts_survive_a_restart(spark, tmp_path):
    rng = random.Random(3)
    events = [(rng.randrange(3), rng.randrange(20), datetime.datetime(2024, 1, 1, 0, rng.randrange(30)), i, rng.choice([*streams.PHASES, "finished"])) for i in range(400)]
    schema = "job_id long, item_id long, ts timestamp, event_id long, phase string"
    base = f"file://{tmp_path}"
    for part in (events[:150], events[150:], [], [(9, 1, None, 1000, "finished"), (9, 1, None, 999, "preparing")]):
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(schema).parquet(f"{base}/in")
        streams.stream_phase_counts(stream, f"{base}/counts", f"{base}/cp", 8)
    got = sorted(map(tuple, streams.current_phase_counts(spark, f"{base}/counts", 8).collect()))
    assert got == sorted(map(tuple, phase_counts(spark.read.parquet(f"{base}/in")).collect()))


def test_screening_in_batches(spark, tmp_path):
    """A token in every title, repeated titles, unknown durations; a batch that runs again gives the same pairs."""
    rng = random.Random(8)
    rows = [(p, i, f"k{p}-{i}", f"song {rng.choice('abc') * 3} {rng.randrange(40) + 10}", None if i % 7 == 0 else float(rng.randrange(200))) for p in (1, 2) for i in range(240)]
    items = spark.createDataFrame(rows, "plan_id long, position long, media_key string, title string, duration_seconds double")
    want = sorted(map(tuple, candidate_pairs(items, 5, 9, 3).collect()))
    screener = CandidateScreener(spark, f"file://{tmp_path}/screen", 5, 9, 3, buckets=8)
    got = []
    for n, (low, high) in enumerate(((0, 100), (100, 101), (101, 240))):
        batch = items.filter((F.col("position") >= low) & (F.col("position") < high))
        pairs = screener.consider(batch, n)
        assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, screener.consider(batch, n).collect()))
        got += map(tuple, pairs.collect())
    assert sorted(got) == want
    most = screener.holders.read().groupBy("plan_id", "kind", "value").count().groupBy("kind").agg(F.max("count")).collect()
    assert dict(map(tuple, most)) == {"token": 9, "title": 1, "duration": 3}


def test_key_archive(spark, tmp_path):
    from marquee.sources.files import KeyArchive

    archive = KeyArchive(spark, f"file://{tmp_path}/keys", 64)
    keys = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert archive.add(spark.range(3000).selectExpr("'k' || id AS value"), 0).count() == 3000
    assert sorted(r.value for r in archive.add(keys("k1", "new", "new", None), 1).collect()) == ["new"]
    assert sorted(r.value for r in archive.add(keys("k1", "new", "new", None), 1).collect()) == ["new"]  # the batch again
    assert archive.add(keys("k2"), 2).count() == 0 and archive.keys().count() == 3001
    assert {r.value for r in archive.contains(keys("k5", "other", "new")).collect()} == {"k5", "new"}
    first, second = list(sizes(tmp_path / "keys").values())[:2]
    assert second < first / 8 and len(archive.table.touched(keys("k5", "other"))) <= 2


def test_damaged_snapshots_name_their_rows(spark, tmp_path):
    """Blocks of 1000 positions, more blocks than one node covers, positions held twice."""
    from marquee.operators import jobs
    from marquee.sources import files

    items = spark.range(40000).selectExpr("CASE WHEN id % 4 = 0 THEN 'q' ELSE 'p' END AS plan", "id AS position", "'t' || id AS title").unionByName(spark.createDataFrame([("p", 9, "second")], "plan string, position long, title string"))
    path = f"file://{tmp_path}/snap"
    files.write_selection_snapshot(items, "plan", ["title"], path)
    assert files.snapshot_damage(spark, path, "plan", ["title"]).count() == 0
    other = items.filter("NOT (plan = 'p' AND position = 17) AND title <> 'second'").withColumn("title", F.expr("CASE WHEN position = 39000 THEN 'x' ELSE title END")).unionByName(spark.createDataFrame([("q", 10**9, "far"), ("new", 3, "n")], "plan string, position long, title string"))
    got = {tuple(r) for r in files.snapshot_damage(spark, path, "plan", ["title"], other).collect()}
    assert got == {("p", 17, "missing"), ("p", 9, "changed"), ("q", 39000, "changed"), ("q", 10**9, "added"), ("new", 3, "added")}
    tree = spark.read.parquet(f"{path}/tree")
    blocks = jobs.differing_blocks(tree, jobs.hash_tree(jobs.hashed_rows(other, "plan", ["title"]), "plan"), "plan")
    assert {tuple(r) for r in blocks.collect()} == {("p", 0), ("q", 39), ("q", 10**6), ("new", 0)}


def test_checked_writes_are_one_pass(spark, tmp_path):
    from marquee.functions import parse
    from marquee.sources.rejects import write_checked

    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for b in rows:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, "5k", "1:30"), (2, "1.23456k", "1:75"), (3, None, "x"), (4, "-3", "-5"), (5, "99999999999b", " 7 h"), (6, "many", "1:2:3:4")], "id long, n string, d string").mapInArrow(count, "id long, n string, d string")
    clean, rejects, counts = write_checked(df, f"file://{tmp_path}/out", {"count": parse.count_reason(F.col("n")), "duration": parse.duration_reason(F.col("d"))}, {k: parse.REASONS[k] for k in ("count", "duration")})
    assert seen.value == 6 and [r.id for r in clean.collect()] == [1] and seen.value == 6
    assert {r.id: r.reasons for r in rejects.collect()} == {
        2: {"count": "not whole", "duration": "above 59"}, 3: {"count": "empty", "duration": "no duration"}, 4: {"count": "negative", "duration": "negative"}, 5: {"count": "too large"}, 6: {"count": "no count", "duration": "no duration"},
    }
    assert counts["rows"] == 6 and counts["clean"] == 1 and counts["rejected"] == 5 and counts["count: empty"] == 1 and counts["duration: negative"] == 1 and counts["count: too large"] == 1


def test_reasons_are_known_ones(spark):
    from marquee.functions import parse

    texts = ["", " ", "x", "-1", "1.5", "1.55k", "1e9", "9" * 30, "1:99", "99:1:1", "5 d", "2024-02-31", "20241301", "2024", "exact:99", "99999", "9p", "31k", "513", "best", "0", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    pairs = {"count": (parse.parse_count, parse.count_reason), "duration": (parse.parse_duration, parse.duration_reason), "day": (parse.parse_date, parse.date_reason), "video": (parse.parse_video_quality, parse.video_quality_reason), "audio": (parse.parse_audio_quality, parse.audio_quality_reason)}
    for rule, (value, reason) in pairs.items():
        for r in df.select("t", value(F.col("t")).isNotNull().alias("ok"), reason(F.col("t")).alias("reason")).collect():
            assert (r.reason is None) == r.ok and (r.ok or r.reason in parse.REASONS[rule]), (rule, r)


def test_file_hashes_by_size(spark, tmp_path):
    """Files of very different sizes, empty ones and odd names; the largest has a partition of its own."""
    import hashlib

    from marquee.sources import files

    names = {f"d{i % 3}/f {i} é.bin": bytes([i]) * (i * 10) for i in range(40)} | {"large.bin": b"x" * 50_000, "skip.txt": b"no"}
    for name, data in names.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {(str(tmp_path / n), len(d), hashlib.sha256(d).hexdigest()) for n, d in names.items() if n != "skip.txt"}
    spark.dataSource.register(files.FileHashes)
    read = spark.read.format("file_hashes").option("glob", "*.bin").option("split_bytes", 10_000).option("chunk_bytes", 7_000).load(f"file://{tmp_path}")
    assert {(r.path.removeprefix("file://"), r.size, r.sha256) for r in read.collect()} == want and read.count() == 41
    parts = files._FileHashReader({"path": str(tmp_path), "glob": "*.bin", "split_bytes": "10000"}).partitions()
    assert len(parts) > 3 and [len(p.value) for p in parts if any(s == 50_000 for _, s in p.value)] == [1]
    assert files.hash_files(spark, f"file://{tmp_path}", "*.bin", most_bytes=100).count() == 40  # without the empty file


def test_large_files_on_unknown_systems_are_named():
    from marquee.sources import files

    with pytest.raises(files.LargeFileError, match="viewfs://store/x"):
        files._digest("viewfs://store/x", 10)
