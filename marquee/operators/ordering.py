"""Places of rows in an order, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marquee.sources.tables import stored


def before(df: DataFrame, by: list[str | Column], per: list[str] = (), value: str | None = None, out: str = "before", row: str | None = None) -> DataFrame:
    """Add ``out``: the number of rows (or the sum of ``value``) that come earlier in the order of ``by``, within ``per``
    (which ``by`` starts with).

    No window covers a whole group: rows are dealt by range over all of ``by``, so a group that holds a third of them
    spreads over many partitions. Each partition counts its own part; only the first group of a partition can
    have begun earlier, so at most one offset per partition is broadcast. Rows equal in ``by`` get different places.
    ``row``: also add a number of this name that no other row has.
    """
    per = list(per)
    amount = F.lit(1).cast("long") if value is None else F.col(value)
    dealt = stored(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()))
    keys = ["_part", *per]
    parts = dealt.groupBy(*keys).agg(F.sum(amount).alias("_amount"))
    earlier = Window.partitionBy(*per).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("_offset", F.sum("_amount").over(earlier)).filter("_offset > 0").select(*[F.col(k).alias(f"_{k}") for k in keys], "_offset")
    inside = Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = dealt.withColumn("_local", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    joined = local.join(F.broadcast(offsets), same, "left")
    return joined.select(*df.columns, *([F.col("_row").alias(row)] if row else []), (F.col("_local") + F.coalesce("_offset", F.lit(0))).cast("long").alias(out))


def recent(df: DataFrame, by: list[str], per: list[str], value: str | Column, history: int, out: str = "held", partitions: int | None = None) -> DataFrame:
    """Add ``out``: the ``value`` of the last ``history`` rows before each in the order of ``by``, within ``per``, earliest first.

    A frame of bounded length over groups of any size. Rows are dealt by range over ``per`` and ``by``, so a group that holds a third of
    them spreads over many partitions. A partition lacks only what stands before its first group's first row: the last
    ``history`` rows of that group in the partitions before it. These are fetched by their numbers among the last rows that
    each partition gives away (``history`` of its last group at most), and stand before the partition's own rows in the frame.
    Rows equal in ``per`` and ``by`` come in any order.
    """
    keys = [*per, *by]
    rows = df.select("*", (F.col(value) if isinstance(value, str) else value).alias("_value"))
    ranged = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    dealt = stored(ranged.withColumn("_part", F.spark_partition_id()))
    group = F.struct(*per)
    edges = dealt.groupBy("_part").agg(F.min(group).alias("_first"), F.max(group).alias("_last"))
    # The last rows of each partition's last group, one short list per partition, numbered through each group.
    closing = dealt.join(F.broadcast(edges.select("_part", "_last")), "_part").filter(group.eqNullSafe(F.col("_last")))
    backwards = Window.partitionBy("_part").orderBy(*[F.col(c).desc() for c in by])
    given = closing.withColumn("_back", F.row_number().over(backwards)).filter(F.col("_back") <= history).select("_part", F.col("_last").alias("_group"), F.struct(*[F.col(c) for c in by]).alias("_by"), "_value", "_back")
    through = Window.partitionBy("_group").orderBy("_part", F.col("_back").desc())
    given = stored(given.withColumn("_n", F.row_number().over(through)))
    # How many of these stand before each partition that goes on with the group of an earlier one.
    sums = given.groupBy("_group", "_part").agg(F.max("_n").alias("_upto"))
    goes_on = edges.select(F.col("_part").alias("_to"), F.col("_first").alias("_group")).join(sums, "_group").filter("_part < _to").groupBy("_to", "_group").agg(F.max("_upto").alias("_upto"))
    wanted = goes_on.select(F.col("_to").alias("_part"), "_group", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_upto") - history + 1), F.col("_upto"))).alias("_n"))
    halo = wanted.join(given.drop("_part"), ["_group", "_n"]).select(*[F.col(f"_group.{c}").alias(c) for c in per], *[F.col(f"_by.{c}").alias(c) for c in by], "_value", "_part", F.lit(False).alias("_own"), F.col("_n").cast("long").alias("_n"))
    frame = Window.partitionBy("_part", *per).orderBy("_own", "_n", *by).rowsBetween(-history, -1)
    both = dealt.withColumns({"_own": F.lit(True), "_n": F.lit(0).cast("long")}).unionByName(halo, allowMissingColumns=True)
    return both.withColumn(out, F.collect_list("_value").over(frame)).filter("_own").select(*df.columns, out)
