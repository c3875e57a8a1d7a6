"""What several operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.operators.ordering import before  # noqa: F401
from marquee.sources.tables import discard, stored  # noqa: F401

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracted(links: DataFrame, most: int = 1_000_000) -> DataFrame:
    """Links (u, v) of stars around the least nodes, which connect what ``links`` (columns u, v of type long) do within a partition, up to
    ``most`` links at a time; with what other partitions have, they connect the same as before."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def out() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held))
            nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            top = forest(len(nodes), at[: len(u)], at[len(u) :])
            moved = np.flatnonzero(top != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[top[moved]])], names=["u", "v"])

        for b in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in b.columns))
            rows += b.num_rows
            if rows >= most:
                yield out()
                held, rows = [], 0
        if rows:
            yield out()

    return links.select("u", "v").mapInArrow(work, "u long, v long")


def are_stars(links: DataFrame) -> bool:
    """Whether no node of the distinct ``links`` (u, v) hangs on two others, or on one that hangs itself."""
    ends = links.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 OR ups = 1 AND least = 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b), component being the least node that links reach.

    Each partition's links are contracted to stars first, which is all there is to do if they fill one partition only. Then large-star and
    small-star steps alternate; edges stay in Spark, and each round is cut off by a stored table.
    """
    given = edges.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("u"), F.least("a", "b").cast("long").alias("v"))
    now = stored(contracted(given.repartition("u", "v")))
    for _ in range(most_rounds):
        if are_stars(now):
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        past, now = now, stored(small)
        discard(past)
    else:
        raise RuntimeError(f"links did not settle in {most_rounds} rounds")
    tops = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, least: int = 4096) -> Iterator[dict[str, np.ndarray]]:
    """Columns of consecutive rows, cut only where ``key`` changes; rows come sorted by ``key`` and hold no nulls."""
    held: list[dict[str, np.ndarray]] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)})
        rows += b.num_rows
        if rows < least:
            continue
        cols = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
        k = cols[key]
        ends = np.flatnonzero(k[1:] != k[:-1]) + 1
        done = 0
        while len(ends) and ends[-1] - done > 0:
            at = int(ends[min(np.searchsorted(ends, done + least), len(ends) - 1)])
            if at <= done:
                break
            yield {n: c[done:at] for n, c in cols.items()}
            done = at
        held = [{n: c[done:] for n, c in cols.items()}]
        rows = len(k) - done
    if rows:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def inner_pairs(key: np.ndarray, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) with equal keys, of a sorted array, some ``most`` at a time."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(edge, len(key)))
    after = np.repeat(edge + sizes, sizes) - np.arange(len(key)) - 1  # later rows of the same key
    total, done = np.cumsum(after), 0
    while done < len(key):
        end = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + most, "right")))
        n = after[done:end]
        i = np.repeat(np.arange(done, end), n)
        yield i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        done = end


def partnered(key: np.ndarray, short: np.ndarray, most: int, large: int = 64) -> np.ndarray:
    """Rows of a sorted ``key`` that share it with a row whose short code differs in ``most`` bits at most; all rows of larger groups."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(edge, len(key)))
    sizes = np.repeat(sizes, sizes)
    stays = sizes > large
    small = np.flatnonzero((sizes > 1) & ~stays)
    for i, j in inner_pairs(key[small]) if len(small) else ():
        near = np.bitwise_count(short[small[i]] ^ short[small[j]]) <= most
        stays[small[i[near]]] = stays[small[j[near]]] = True
    return stays


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index linked with each of 0..n-1 through the links (a[i], b[i])."""
    label = np.arange(n)
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        m = np.minimum(la, lb)
        np.minimum.at(label, la, m)
        np.minimum.at(label, lb, m)
        while (label[label] != label).any():
            label = label[label]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
