"""File listings, hashes, key archives, selection snapshots and fingerprint text."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import LongType, StringType, StructField, StructType

from marquee.operators.jobs import differing_blocks, differing_rows, hash_tree, hashed_rows, selection_hash
from marquee.sources.buckets import BucketedTable
from marquee.sources.tables import discard, stored

#: Suffixes of files that accompany an output.
SIDECARS = ("part", "ytdl", "tmp", "json", "jpg", "jpeg", "png", "webp", "vtt", "srt", "ass", "lrc", "description")
_PRINT = "duration_seconds double, has_audio boolean, has_video boolean, audio_words array<bigint>, video_samples array<string>"
_FRAME_BYTES = 256


class LargeFileError(RuntimeError):
    """A file is too large for Spark's reader, and on a file system that the tasks can't open by themselves."""


def _open(uri: str):
    """A stream of a file. Tasks open large files without Spark's reader, with the file systems that pyarrow has."""
    from pyarrow import fs

    local = re.match("file:/*(/.*)", uri)
    try:
        system, name = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(uri, safe=":/"))
    except Exception as e:
        raise LargeFileError(f"{uri} is above most_bytes and can't be opened outside Spark ({e}); give hash_files a greater most_bytes (2 GiB at most)") from e
    return system.open_input_stream(name)


def _digest(uri: str, chunk_bytes: int) -> str:
    h = hashlib.sha256()
    with _open(uri) as stream:
        while part := stream.read(chunk_bytes):
            h.update(part)
    return h.hexdigest()


def hash_files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int = 1 << 28, chunk_bytes: int = 1 << 20) -> DataFrame:
    """(path, size, sha256) of files below ``path``, of any size. Files up to ``most_bytes`` are read by Spark; larger ones are streamed in
    chunks by the task that hashes them, so memory is bounded, where pyarrow knows the file system (a ``LargeFileError`` names the file
    where it doesn't). The length filter reaches the source. Spark lists no empty files; the source ``file_hashes`` does."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    small = files.filter(F.col("length") <= most_bytes).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_digest(uri, chunk_bytes) for uri in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], names=["path", "size", "sha256"])

    large = files.filter(F.col("length") > most_bytes).select("path", F.col("length").alias("size"))
    # A task of its own for about every large file, whatever the order in which the listing came.
    spread = large.repartition(64, "path").mapInArrow(work, "path string, size long, sha256 string")
    return small.unionByName(spread)


class FileHashes(DataSource):
    """``spark.read.format("file_hashes")``: (path, size, sha256) of files below ``path``, on file systems that pyarrow knows.

    Partitions follow file sizes: files are dealt, largest first, to the emptiest of the partitions that ``split_bytes`` (128 MiB by default)
    asks for, so many small files share a task and a large one has its own. Options: path, glob, split_bytes, chunk_bytes.
    """

    @classmethod
    def name(cls) -> str:
        return "file_hashes"

    def schema(self) -> str:
        return "path string, size long, sha256 string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _FileHashReader(self.options)


class _FileHashReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*")
        self.split_bytes, self.chunk_bytes = int(options.get("split_bytes", 1 << 27)), int(options.get("chunk_bytes", 1 << 20))

    def partitions(self) -> list[InputPartition]:
        import heapq
        from fnmatch import fnmatch

        from pyarrow import fs

        local = re.match("(?:file:/*)?(/.*)", self.path)
        system, top = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(quote(self.path, safe=":/"))
        scheme = "file://" if local else re.match(r"[^:]+://", self.path)[0]
        found = [f for f in system.get_file_info(fs.FileSelector(top, recursive=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, self.glob)]
        n = max(1, min(len(found), -(-sum(f.size for f in found) // self.split_bytes)))
        bins: list[tuple[int, int, list]] = [(0, i, []) for i in range(n)]
        for f in sorted(found, key=lambda f: (-f.size, f.path)):
            held, i, files = heapq.heappop(bins)
            heapq.heappush(bins, (held + f.size, i, [*files, (scheme + f.path, f.size)]))
        return [InputPartition(files) for _, _, files in bins]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for uri, size in partition.value:
            yield uri, size, _digest(uri, self.chunk_bytes)


def hash_texts(df: DataFrame, text: str = "content") -> DataFrame:
    return df.withColumn("sha256", F.sha2(F.col(text), 256)).drop(text)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, mtime, size); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def newest_output_per_item(listing: DataFrame, wanted: str | None) -> DataFrame:
    """(media_key, name): of the files named ``... [key] ...`` that are no sidecars the newest, then largest; if any has the wanted suffix, of
    those only."""
    key = F.regexp_extract("name", r"\[([^\[\]]+)\]", 1)
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
    files = listing.withColumns({"media_key": key, "_suffix": suffix}).filter((F.col("media_key") != "") & ~F.col("_suffix").isin(*SIDECARS))
    right = (F.col("_suffix") == wanted.lower()) if wanted else F.lit(True)
    return files.groupBy("media_key").agg(F.max_by("name", F.struct(right.cast("int"), "mtime", "size", "name")).alias("name"))


def new_archive_keys(archive: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distinct keys "extractor id" that the archive lacks."""
    line = F.concat_ws(" ", F.trim("extractor"), F.trim("media_key"))
    return candidates.select(line.alias("value")).distinct().join(archive.select(F.trim("value").alias("value")), "value", "left_anti")


def append_archive(archive_path: str, candidates: DataFrame) -> DataFrame:
    """Append new keys to the text archive and return its lines; a second run appends nothing."""
    spark = candidates.sparkSession
    try:
        archive = spark.read.text(archive_path)
        archive.schema  # noqa: B018  (a missing path fails here)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        archive = spark.createDataFrame([], "value string")
    new_archive_keys(archive, candidates).write.mode("append").text(archive_path)
    return spark.read.text(archive_path)


class KeyArchive:
    """Keys seen so far, in buckets by their hash: a batch reads and rewrites only the buckets that its keys fall into, and one that runs
    again changes nothing."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.table = BucketedTable(spark, path, ["value"], StructType([StructField("value", StringType()), StructField("batch", LongType())]), buckets)

    def contains(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` (value) that the archive holds."""
        return keys.join(self.table.read(self.table.touched(keys)).select("value"), "value", "left_semi")

    def add(self, keys: DataFrame, batch: int) -> DataFrame:
        """Put in the keys that it lacks; returns them, also when the batch runs again."""
        wanted = stored(keys.select("value").filter("value IS NOT NULL").distinct())
        old = self.table.read(self.table.touched(wanted), self.table.before(batch))
        new = stored(wanted.join(old, "value", "left_anti").withColumn("batch", F.lit(batch).cast("long")))
        self.table.merge(new, lambda rows, changes: rows.unionByName(changes), batch)
        discard(wanted)
        return new.select("value")

    def keys(self) -> DataFrame:
        return self.table.read().select("value")


def write_selection_snapshot(items: DataFrame, per: str, columns: list[str], path: str) -> DataFrame:
    """Freeze selected rows below ``path`` with their hash per plan, and the hashes of their rows and blocks; returns the hash rows."""
    items.write.parquet(f"{path}/items")
    frozen = items.sparkSession.read.parquet(f"{path}/items")
    selection_hash(frozen, per, columns).write.parquet(f"{path}/hashes")
    hashed_rows(frozen, per, columns).write.parquet(f"{path}/rows")
    hash_tree(items.sparkSession.read.parquet(f"{path}/rows"), per).write.parquet(f"{path}/tree")
    return items.sparkSession.read.parquet(f"{path}/hashes")


def read_selection_snapshot(spark: SparkSession, path: str, per: str, columns: list[str]) -> DataFrame:
    """Rows of the plans whose recomputed hash is the stored one; the others are rejected whole."""
    items, hashes = spark.read.parquet(f"{path}/items"), spark.read.parquet(f"{path}/hashes")
    fine = hashes.join(selection_hash(items, per, columns), [per, "content_hash"], "left_semi").select(per)
    return items.join(fine, per, "left_semi")


def snapshot_damage(spark: SparkSession, path: str, per: str, columns: list[str], items: DataFrame | None = None) -> DataFrame:
    """(plan, position, problem): which rows of a snapshot (or of ``items`` in its place) aren't those that were frozen. Hash trees are compared from
    the top, and rows only in the blocks that differ."""
    now = stored(hashed_rows(spark.read.parquet(f"{path}/items") if items is None else items, per, columns))
    blocks = stored(differing_blocks(spark.read.parquet(f"{path}/tree"), hash_tree(now, per), per))
    return differing_rows(spark.read.parquet(f"{path}/rows"), now, blocks, per)


def fingerprint_to_text(df: DataFrame) -> Column:
    """Canonical JSON of duration_seconds, has_audio, has_video, words and frames (binary)."""
    samples = F.transform("frames", lambda f: F.lower(F.hex(f)))
    return F.to_json(F.struct(F.col("words").alias("audio_words"), "duration_seconds", "has_audio", "has_video", samples.alias("video_samples")), {"ignoreNullFields": "false"})


def fingerprint_from_text(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``p`` (the parsed fingerprint), ``reason`` (why it is no fingerprint, null if it is one) and ``valid``. Closed on errors: words
    outside 0 .. 2^32 - 1, frames of over 256 bytes or not hexadecimal, a stream flag that is no boolean or a negative duration make the row
    invalid; the first of these is the reason."""
    raw = lambda name: F.get_json_object(column, f"$.{name}")
    out = df.withColumn("p", F.from_json(column, _PRINT))
    words = F.coalesce(F.forall("p.audio_words", lambda w: F.coalesce(w.between(0, 0xFFFFFFFF), F.lit(False))), raw("audio_words").isNull())
    frames = F.coalesce(F.forall("p.video_samples", lambda s: F.coalesce(s.rlike(f"^0*[0-9a-fA-F]{{1,{2 * _FRAME_BYTES}}}$"), F.lit(False))), raw("video_samples").isNull())
    duration = F.coalesce(F.col("p.duration_seconds") >= 0, raw("duration_seconds").isNull())
    flags = F.col("p.has_audio").isNotNull() & F.col("p.has_video").isNotNull()
    reason = (
        F.when(F.col(column).isNull() | (F.trim(column) == ""), "empty").when(F.get_json_object(column, "$").isNull() | ~F.startswith(F.trim(column), F.lit("{")), "no JSON object")
        .when(~F.coalesce(flags, F.lit(False)), "stream flag").when(~F.coalesce(words, F.lit(False)), "words").when(~F.coalesce(frames, F.lit(False)), "frames").when(~F.coalesce(duration, F.lit(False)), "duration")
    )
    return out.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
