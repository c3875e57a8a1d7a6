"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.llm.common import WORD, before, stored, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def _luck(*parts: Column | str | int) -> Column:
    """A fixed pseudo-random order: equal on every run, for every partitioning."""
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce((p if isinstance(p, Column) else F.lit(p)).cast("string"), F.lit("~")) for p in parts]))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, rank, source_size, target) from rows of (source, size).

    Sources in order of code point, null last, take the weights in turn. Targets share ``share`` of all sizes by weight,
    none above ``epochs`` times its source's size: what is above goes to the others by weight, until none is above.
    Each round is one aggregate of the sources; the driver sees two sums.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_null", F.col("source").isNull())
    ranked = stored(before(per_source, ["_null", "source"], out="rank")).drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    w = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * epochs).cast("double"))
    total, level = (w.agg(F.sum("source_size")).first()[0] or 0) * share, 0.0
    held: tuple[float, float] | None = None
    while True:
        over = F.col("_w") * level > F.col("_cap")
        caps, free = w.agg(F.coalesce(F.sum(F.when(over, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("_w"))), F.lit(0.0))).first()
        if (caps, free) == held or free == 0:
            break
        held, level = (caps, free), (total - caps) / free
    return w.withColumn("target", F.least("_cap", F.col("_w") * level)).select("source", "rank", "source_size", "target")


def split_quotas(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, shard, blocks) from (rank, quota): a splitting tree over the shards.

    A node covers a range of shards and holds an exact quota of blocks of every source. Its left half gets its share of
    the node's blocks, drawn without replacement and whatever their source, so the counts per source are a multivariate
    hypergeometric draw; the right half gets the rest. Nodes of one level are drawn together. The number of blocks
    is a parameter, not the number of rows.
    """
    nodes = quotas.filter("quota > 0").select("rank", "quota", F.lit(0).alias("lo"), F.lit(shards).alias("hi"))
    while shards > 1:
        inner = F.col("hi") - F.col("lo") > 1
        node = Window.partitionBy("lo", "hi")
        each = nodes.select("rank", "lo", "hi", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("i"))
        drawn = each.withColumn("_r", F.row_number().over(node.orderBy(_luck("split", F.col("lo"), F.col("hi"), F.col("rank"), F.col("i")), "rank", "i"))).withColumn("_n", F.count("*").over(node))
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        left = F.col("_r") <= F.round(F.col("_n") * (mid - F.col("lo")) / (F.col("hi") - F.col("lo")))
        side = drawn.select("rank", F.when(~inner | left, F.col("lo")).otherwise(mid).alias("lo"), F.when(~inner, F.col("hi")).when(left, mid).otherwise(F.col("hi")).alias("hi"))
        nodes = side.groupBy("rank", "lo", "hi").agg(F.count("*").alias("quota"))
        shards = (shards + 1) // 2
    return nodes.select("rank", F.col("lo").alias("shard"), F.col("quota").alias("blocks"))


def deal_blocks(quotas: DataFrame, shards: int) -> DataFrame:
    """(rank, block, shard, place): the blocks of each source in a random order are dealt out in the tree's counts, so no
    two shards share one; ``place`` is a block's turn after the shuffle within its shard."""
    counts = split_quotas(quotas, shards)
    earlier = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("_from", F.coalesce(F.sum("blocks").over(earlier), F.lit(0)))
    seats = runs.select("rank", "shard", F.explode(F.expr("sequence(_from, _from + blocks - 1)")).alias("seat"))
    blocks = quotas.filter("quota > 0").select("rank", F.explode(F.expr("sequence(0L, quota - 1)")).alias("block"))
    mixed = blocks.withColumn("seat", (F.row_number().over(Window.partitionBy("rank").orderBy(_luck("block", F.col("rank"), F.col("block")), "block")) - 1).cast("long"))
    dealt = mixed.join(seats, ["rank", "seat"])
    turn = Window.partitionBy("shard").orderBy(_luck("turn", F.col("rank"), F.col("block")), "rank", "block")
    return dealt.select("rank", "block", "shard", (F.row_number().over(turn) - 1).cast("long").alias("place"))


def mix_sources(docs: DataFrame, shards: int = 16, blocks_per_shard: int = 64, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as pieces: row (one number per input row), doc_id, source, size, source_size, target, epoch, word_from, n_words, block, shard, place.

    Each source is a stream of its documents in a fixed random order, once per epoch, of which the first ``target`` words
    (rounded) are taken; blocks of equal length cut the streams, and the splitting tree deals the blocks to the shards.
    A document of which nothing is taken gives one row with n_words 0 and no block. Null texts have size 0; a null
    source is a source; repeated rows are documents of their own; an empty table gives no rows.
    """
    counted = stored(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")))  # texts are read once
    sized = counted.withColumn("_luck", _luck("doc", F.col("doc_id")))
    streams = stored(before(sized, ["source", "_luck", "doc_id", "size"], ["source"], "size", out="_start", row="row"))
    targets = stored(source_targets(streams, weights, share, epochs).withColumn("_words", F.round("target").cast("long")))
    block_words = max(1, -(-(targets.agg(F.sum("_words")).first()[0] or 0) // (shards * blocks_per_shard)))
    blocks = stored(deal_blocks(targets.select("rank", F.ceil(F.col("_words") / block_words).cast("long").alias("quota")), shards))
    planned = streams.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    spans = []
    for epoch in range(epochs):
        begin = F.col("source_size") * epoch + F.col("_start")
        spans.append(F.struct(F.lit(epoch).alias("epoch"), begin.alias("begin"), F.greatest(F.lit(0), F.least("size", F.col("_words") - begin)).alias("n")))
    taken = F.filter(F.array(*spans), lambda s: s["n"] > 0)
    rows = planned.select("row", "doc_id", "source", "rank", "size", "source_size", "target", F.explode_outer(taken).alias("s")).select("*", "s.*").drop("s")
    first, last = F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("n") - 1) / block_words)
    parts = rows.withColumn("block", F.explode_outer(F.when(F.col("n") > 0, F.sequence(first, last))))
    start = F.greatest(F.col("begin"), F.col("block") * block_words)
    end = F.least(F.col("begin") + F.col("n"), (F.col("block") + 1) * block_words)
    pieces = parts.withColumn("word_from", start - F.col("begin")).withColumn("n_words", F.coalesce(end - start, F.lit(0)).cast("long"))
    return pieces.join(blocks, ["rank", "block"], "left").select("row", "doc_id", "source", "size", "source_size", "target", "epoch", "word_from", "n_words", "block", "shard", "place")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (a document that a target cuts counts when half of its words are
    taken). Null ids join like values. Rows that share an id are told apart by source, size and their place among equals."""
    pieces = mix_sources(docs, id_col=id_col, text_col=text_col, source_col=source_col, **how)
    per_row = pieces.groupBy("row", "doc_id", "source", "size").agg(F.sum("n_words").alias("taken"))
    per_row = stored(per_row.select("row", "doc_id", "source", "size", F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int").alias("times")))
    by_id = per_row.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("times").alias("times"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(id_col).alias("own"))
    copies = by_id.filter("n = 1 AND times > 0").select("doc_id", "times")
    mixed = rows.join(copies.hint("shuffle_hash"), F.col("own").eqNullSafe(F.col("doc_id"))).select("d", "times")
    many = stored(by_id.filter("n > 1").select(F.col("doc_id").alias("shared")))
    if not many.isEmpty():
        keys = ["_id", "_source", "_size"]
        seats = per_row.join(many, F.col("doc_id").eqNullSafe(F.col("shared")), "left_semi").select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "row", "times")
        seats = before(seats, [*keys, "row"], keys, out="_place").filter("times > 0").select(*[F.col(k).alias(f"_seat{k}") for k in (*keys, "_place")], "times")
        sharing = rows.join(many, F.col("own").eqNullSafe(F.col("shared")), "left_semi").select("d", F.col("own").alias("_id"), F.col("d")[source_col].alias("_source"), word_count(F.col("d")[text_col]).alias("_size"), F.xxhash64(F.col("d")[text_col]).alias("_luck"))
        placed = before(sharing, [*keys, "_luck"], keys, out="_place")
        same = F.lit(True)
        for k in (*keys, "_place"):
            same = same & F.col(k).eqNullSafe(F.col(f"_seat{k}"))
        mixed = mixed.unionByName(placed.join(seats, same).select("d", "times"))
    return mixed.select("d", F.explode(F.sequence(F.lit(1), F.col("times")))).select("d.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = mix_sources(table(spark, sf_dir, "documents"))
    per_row = pieces.groupBy("row", "doc_id", "size", "source_size", "target").agg(F.sum("n_words").alias("taken"), F.count("block").alias("n_pieces"), F.array_sort(F.collect_set("shard")).alias("shards"))
    return per_row.select("doc_id", "size", "source_size", "target", "taken", "n_pieces", "shards")


QUERIES = {"op2_mix": op2_mix}
ORACLE_SQL: dict[str, str] = {}
