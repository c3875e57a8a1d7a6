"""Sharding by a minimax contiguous partition of ordered atomic groups. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import before, stored, table

SHARDS = 16


def _furthest(ends: DataFrame, marks: list[int]) -> dict[int, int]:
    """For each mark the largest ``end`` that is not above it. The table is sorted by ``end`` on disk, so the range filter
    reads only row groups between the marks; the driver gets one row per interval of marks at most."""
    marks = sorted(set(marks))
    inside = ends.filter((F.col("end") > marks[0]) & (F.col("end") <= marks[-1]))
    slot = F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("end")))
    found = {marks[r["slot"]]: r["top"] for r in inside.groupBy(slot.alias("slot")).agg(F.max("end").alias("top")).collect()}
    best = ends.filter(F.col("end") <= marks[0]).agg(F.max("end")).first()[0] or 0
    out = {}
    for m in marks:
        best = max(best, found.get(m, 0))
        out[m] = best
    return out


def smallest_capacity(ends: DataFrame, shards: int, total: int, largest: int, ways: int = 256) -> tuple[int, list[int]]:
    """The least capacity with which a greedy walk fills ``shards`` shards with consecutive groups, and where the shards end.

    The binary search tries ``ways`` capacities at once: in round after round the greedy walks of all of them take their next cut from
    one aggregate of the groups' cumulative ends, and the range between the last that fails and the first that
    fits is searched again.
    """
    low, high = max(-(-total // shards), largest) - 1, -(-total // shards) + largest  # low fails unless it can't be lower; high always fits
    cuts: dict[int, list[int]] = {}
    while high - low > 1 or high not in cuts:
        step = max(1, -(-(high - low) // ways))
        tried = sorted({*range(low + 1, high, step), high})
        walks = {c: [0] for c in tried}
        for _ in range(shards):
            going = {c: w for c, w in walks.items() if w[-1] < total}
            if not going:
                break
            reach = _furthest(ends, [w[-1] + c for c, w in going.items()])
            for c, w in going.items():
                w.append(reach[w[-1] + c])
        fits = [c for c in tried if walks[c][-1] >= total]
        high = min(fits)
        low = max([low, *(c for c in tried if c < high)])
        cuts = {high: walks[high][1:]}
    return high, cuts[high]


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: every row in a shard 0 to shards - 1, so that the largest shard's bytes are the least
    that consecutive atomic groups allow.

    Equal texts form a group and are never separated; groups are ordered by the SHA-256 of their text, which does
    not depend on the order of the rows. Size is the text's UTF-8 bytes plus 1; a null text counts as empty and is grouped with
    empty texts. ``slot`` numbers a shard's rows from 0 in the order of (group, doc_id). Repeated rows get slots of
    their own; an empty table gives no rows. A group of any size is summed before it is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stored(docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("_bytes"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")).withColumn("size", F.col("_bytes") + 1))
    groups = sized.groupBy("_group").agg(F.sum("size").alias("_size"))
    walked = before(groups, ["_group"], value="_size", out="_from").withColumn("end", F.col("_from") + F.col("_size"))
    ends = stored(walked.select("_group", "end", "_size").repartitionByRange("end").sortWithinPartitions("end"))
    total, largest = ends.agg(F.coalesce(F.max("end"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    cuts = smallest_capacity(ends, shards, total, largest)[1] if total else []
    last = {r["end"]: r["_group"] for r in ends.filter(F.col("end").isin(cuts)).select("end", "_group").collect()} if cuts else {}
    shard: Column = F.lit(0)
    for c in cuts[:-1]:
        if c in last:
            shard = shard + F.when(F.col("_group") > F.lit(last[c]), F.lit(1)).otherwise(F.lit(0))
    placed = sized.withColumn("shard", shard.cast("int"))
    return before(placed, ["shard", "_group", "doc_id"], ["shard"], out="slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shard_documents(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op5_shard": op5_shard}
ORACLE_SQL: dict[str, str] = {}
