"""Tables that are written together with what can't go into them, and counted on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def write_checked(df: DataFrame, path: str, reasons: dict[str, Column], known: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """Write ``df`` below ``path`` and return its clean rows, its rejects, and counts, all from one pass over it.

    ``reasons``: per rule a column with the reason why it rejects a row, or null; ``known``: the reasons that a rule can give. A
    row without any is clean. Rejects have ``reasons``, a map from rule to reason. Counts are keyed by rule and reason
    ("rule: reason"), besides rows, clean and rejected; they are gathered by the job that writes the table.
    """
    given = F.map_filter(F.create_map(*[c for rule, reason in reasons.items() for c in (F.lit(rule), reason)]), lambda _, v: v.isNotNull())
    checked = df.withColumn("reasons", given).withColumn("_clean", F.size("reasons") == 0)
    seen = Observation()
    of = lambda rule, reason: F.count_if(F.coalesce(F.col("reasons")[rule] == reason, F.lit(False)))
    counts = [of(rule, reason).alias(f"{rule}: {reason}") for rule, all_ in known.items() for reason in all_]
    observed = checked.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if("_clean").alias("clean"), F.count_if(~F.col("_clean")).alias("rejected"), *counts)
    observed.write.partitionBy("_clean").parquet(path)
    back = df.sparkSession.read.schema(checked.schema).parquet(path)
    return back.filter("_clean").select(*df.columns), back.filter("NOT _clean").drop("_clean"), dict(seen.get)
