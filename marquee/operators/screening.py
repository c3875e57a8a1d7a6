"""Candidate pairs batch by batch, from a stored index of each key's last holders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.window import Window

from marquee.functions.text import title_tokens
from marquee.operators.duplicates import PLAN, recent_duration_neighbors, scored_candidates, union_candidates
from marquee.operators.ordering import recent
from marquee.sources.buckets import BucketedTable
from marquee.sources.tables import stored

_ITEM = ["position", "media_key", "title", "duration_seconds"]
_KEY = [PLAN, "kind", "value"]
_SCHEMA = (
    StructType().add(PLAN, LongType()).add("kind", StringType()).add("value", StringType()).add("position", LongType()).add("media_key", StringType())
    .add("title", StringType()).add("duration_seconds", DoubleType())
)


class CandidateScreener:
    """``duplicates.candidate_pairs`` for plans that grow.

    The index holds, for every token, title and duration bucket of a plan, its last items with what a comparison needs: so many as
    the histories ask for. A batch of later items (positions above all before them) meets the holders of its own keys and
    its own items, and then takes their places in the buckets that it touches. Work and writes follow the batch; the pairs of all
    batches are those of one. A batch that runs again gives the same pairs and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = 12, token_history: int = 64, duration_history: int = 8, seconds: float = 5.0, buckets: int = 64):
        self.most, self.seconds = most, seconds
        self.histories = {"token": token_history, "title": 1, "duration": duration_history}
        self.holders = BucketedTable(spark, path, _KEY, _SCHEMA, buckets)

    def _postings(self, items: DataFrame) -> DataFrame:
        """A row per key that an item holds."""
        tokens = title_tokens(F.col("title"))
        core, bucket = F.array_join(tokens, " "), F.floor(F.col("duration_seconds") / self.seconds).cast("string")
        one = lambda kind, value, there: F.when(there, F.struct(F.lit(kind).alias("kind"), value.alias("value")))
        titles = F.transform(tokens, lambda t: F.struct(F.lit("token").alias("kind"), t.alias("value")))
        others = F.array_compact(F.array(one("title", core, core != ""), one("duration", bucket, F.col("duration_seconds") >= 0)))
        return items.select(PLAN, *_ITEM, F.explode(F.concat(titles, others)).alias("k")).select(*[F.col(c) for c in (PLAN, *_ITEM)], "k.*").select(*_SCHEMA.names)

    def _last(self, rows: DataFrame) -> DataFrame:
        """The last rows of every key. First in a share of each key's rows, then among those, so a key of any size never meets in one task."""
        history = F.element_at(F.create_map(*[F.lit(x) for kv in self.histories.items() for x in kv]), F.col("kind"))
        by = lambda *more: Window.partitionBy(*_KEY, *more).orderBy(F.col("position").desc(), F.col("media_key").desc())
        shares = rows.withColumn("_share", F.pmod(F.xxhash64("position"), F.lit(64)))
        few = shares.withColumn("_n", F.row_number().over(by("_share"))).filter(F.col("_n") <= history)
        return few.withColumn("_n", F.row_number().over(by())).filter(F.col("_n") <= history).select(*_SCHEMA.names)

    def consider(self, items: DataFrame, batch: int) -> DataFrame:
        """(plan, left_media_key, right_media_key, metadata_score, rank) of a batch's items (plan, position, media_key, title, duration_seconds)
        against all before them."""
        new = stored(items.select(F.col(PLAN).cast("long").alias(PLAN), *[F.col(c).cast(_SCHEMA[c].dataType).alias(c) for c in _ITEM]))
        postings = stored(self._postings(new))
        # An item looks into the duration buckets beside its own, too.
        steps = F.explode(F.when(F.col("kind") == "duration", F.array(*[(F.col("value").cast("long") + d).cast("string") for d in (-1, 0, 1)])).otherwise(F.array("value"))).alias("value")
        looked = postings.select(PLAN, "kind", steps).distinct()
        held = stored(self.holders.read(self.holders.touched(looked), self.holders.before(batch)).join(looked, _KEY, "left_semi"))
        both = held.withColumn("is_new", F.lit(False)).unionByName(postings.withColumn("is_new", F.lit(True)))

        def earlier(kind: str) -> DataFrame:
            rows = recent(both.filter(F.col("kind") == kind).select(*_KEY, "position", "is_new"), ["position"], _KEY, "position", self.histories[kind])
            return rows.filter("is_new").select(PLAN, "position", F.explode("held").alias("earlier"))

        near = recent_duration_neighbors(both.filter("kind = 'duration'").select(PLAN, "position", "duration_seconds"), self.histories["duration"], self.seconds)
        near = near.join(new.select(PLAN, "position"), [PLAN, "position"], "left_semi")
        known = new.unionByName(held.select(*new.columns).dropDuplicates([PLAN, "position"]))
        pairs = stored(scored_candidates(known, union_candidates(earlier("token"), earlier("title"), near), self.most))
        self.holders.merge(postings, lambda old, rows: self._last(old.unionByName(rows)), batch)
        return pairs
