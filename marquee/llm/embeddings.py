"""Near-duplicate embeddings: iterative quantisation, multi-index Hamming tables, and exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm.common import components, inner_pairs, partnered, stored, table, whole_runs

#: Vectors (at most) that a rotation is fitted on: those with the least hash of their id.
FIT_ROWS = 20_000
#: Chance with which a pair at the similarity threshold meets in some table.
RECALL = 0.98


def clean_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) in double precision; v is null where the vector is null, empty, zero or has a null or non-finite component."""
    v = F.col(vector_col).cast("array<double>")
    inf = F.lit(float("inf"))
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != inf)) & F.exists(v, lambda x: x != 0), F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, v).alias("v"))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_rotation(x: np.ndarray, bits: int, seed: int, steps: int = 30) -> np.ndarray:
    """Projection (dimensions x bits) of iterative quantisation: principal axes, turned so that signs lose least.

    Columns alternate between the binary codes of the turned data and the best orthogonal rotation towards these. Beyond the
    number of dimensions, further bits come from further rotations.
    """
    rng = np.random.default_rng(seed)
    cov = x.T @ x / max(len(x), 1)
    axes = np.linalg.eigh(cov)[1][:, ::-1]
    d, blocks = x.shape[1], []
    for _ in range(-(-bits // d)):
        turn = np.linalg.qr(rng.standard_normal((d, d)))[0]
        y = x @ axes
        for _ in range(steps if len(x) >= d else 0):
            u, _, vt = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
            turn = (u @ vt).T
        blocks.append(axes @ turn)
    return np.concatenate(blocks, axis=1)[:, :bits]


def table_plan(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits per table): tables take about log2(rows) bits, so a bucket holds few vectors at any size; as many tables as
    a pair at the threshold needs to agree in one of them with chance ``recall``."""
    bits = max(8, min(40, math.ceil(math.log2(max(rows, 2)))))
    p = math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - min((1 - p) ** bits, 0.999)))), bits


def near_vectors(df: DataFrame, threshold: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", fit_rows: int = FIT_ROWS, recall: float = RECALL, chunk: int = 512) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link when their cosine in double precision reaches ``threshold``; vectors that are null, zero or not finite, and rows
    without an id, link with nothing. Equal vectors are found by value, before any search, and stand as one with their
    number. A rotation fitted on at most ``fit_rows`` vectors gives every vector a binary code; multi-index tables
    fetch pairs that agree on one of its parts. Seats are a key, an id and a short code that drops chance meetings; only vectors
    with a partner are sent on for the exact cosine. Buckets of over ``chunk`` rows are compared in pairs of chunks, spread over
    tasks; within a bucket no pair is written out, only sums and links. Vectors of different lengths never link. Repeated rows
    count as vectors of their own. Recall at the threshold is at least about ``recall``. An empty table gives no rows.
    """
    rows = stored(clean_vectors(df, id_col, vector_col))
    valid = rows.filter("v is not null and vec_id is not null")
    # Equal directions that differ in length stay apart: the exact step links them.
    groups = stored(valid.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    links = None
    sizes = [r[0] for r in groups.select(F.size("v").alias("d")).distinct().orderBy("d").collect()]
    for d in sizes:
        part = groups.filter(F.size("v") == d)
        found = _links(part, d, threshold, fit_rows, recall, chunk)
        links = found if links is None else links.unionByName(found)
    if links is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    links = stored(links)
    degree = links.filter("n > 0").groupBy(F.col("vec_id").alias("rep")).agg(F.sum("n").alias("near"))
    joined = components(links.filter("other is not null").select(F.col("vec_id").alias("a"), F.col("other").alias("b"))).withColumnRenamed("node", "rep")
    reps = groups.join(degree, "rep", "left").join(joined, "rep", "left").select("v", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "rep").alias("_c"))
    out = rows.join(reps, ["v"], "left")
    links_of = F.when(F.col("vec_id").isNull(), F.lit(0)).otherwise(F.coalesce("_n", F.lit(0))).cast("long")
    top = F.when(F.col("vec_id").isNotNull(), F.coalesce("_c", "vec_id"))
    return out.select("vec_id", links_of.alias("n_links"), top.alias("component_id"), F.coalesce(top == F.col("vec_id"), F.lit(True)).alias("kept"))


def _links(groups: DataFrame, d: int, threshold: float, fit_rows: int, recall: float, chunk: int) -> DataFrame:
    """(vec_id, n, other): per representative its linked vectors, copies counted (in parts), and links that connect exactly what is linked."""
    spark = groups.sparkSession
    sample = groups.orderBy(F.xxhash64("rep"), "rep").limit(fit_rows).select("v")
    fit = unit(np.array([r["v"] for r in sample.collect()], dtype=np.float64))
    tables, bits = table_plan(groups.count(), threshold, recall)
    turn = spark.sparkContext.broadcast(fit_rotation(fit, tables * bits, seed=7))
    p = math.acos(threshold) / math.pi
    above = lambda n: math.ceil(n * p + 4 * math.sqrt(n * p * (1 - p)))
    most, short_bits = above(tables * bits), min(64, tables * bits)
    kind = "<u2" if bits <= 16 else "<u4" if bits <= 32 else "<u8"

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, places = np.uint64(1) << np.arange(bits, dtype=np.uint64), np.uint64(1) << np.arange(short_bits, dtype=np.uint64)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                x = unit(part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
                ones = (x @ turn.value >= 0).astype(np.uint64)
                keys = ones.reshape(len(x), tables, bits) @ weight
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([k.tobytes() for k in keys.astype(kind)], pa.binary()), pa.array((ones[:, :short_bits] @ places).view(np.int64))], names=["vec_id", "code", "short"])

    coded = stored(groups.select(F.col("rep").alias("vec_id"), "v").mapInArrow(code, "vec_id long, code binary, short long"))

    def seats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(tables, dtype=np.int64) << 40
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                keys = np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, tables).astype(np.int64) + number
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), tables)), pa.array(np.repeat(part.column(2).to_numpy(), tables))], names=["bucket", "vec_id", "short"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "bucket", 1 << 16):
            stays = partnered(run["bucket"], run["short"].view(np.uint64), above(short_bits))
            yield pa.RecordBatch.from_arrays([pa.array(run["bucket"][stays]), pa.array(run["vec_id"][stays])], names=["bucket", "vec_id"])

    seated = coded.mapInArrow(seats, "bucket long, vec_id long, short long").repartition("bucket").sortWithinPartitions("bucket")
    near = stored(seated.mapInArrow(meet, "bucket long, vec_id long"))
    tagged = near.join(near.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > chunk), "bucket", "left")
    number = F.shiftright("bucket", 40).cast("int").alias("table")
    plain = tagged.filter("n is null").select("bucket", "vec_id", number, F.lit(0).alias("own"), F.lit(True).alias("same"))
    chunks = F.ceil(F.col("n") * 2 / chunk).cast("int")
    split = tagged.filter("n is not null").select("bucket", "vec_id", number, F.pmod(F.xxhash64("vec_id"), chunks).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    split = split.select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "vec_id", "table", "own", (F.col("own") == F.col("other")).alias("same"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in whole_runs(batches, "bucket", 2 * chunk):
            keys, own, same, place = np.frombuffer(b"".join(run["code"]), kind).reshape(-1, tables), run["own"], run["same"].astype(bool), run["table"]
            x = unit(np.stack(run["v"]).astype(np.float64))
            n, top = np.zeros(len(x), np.int64), np.arange(len(x))
            for a, b in inner_pairs(run["bucket"], 50_000):
                # Chunks of one bucket meet once; a pair counts in the first table where its keys agree.
                fine = (same[a] | (own[a] != own[b])) & (np.bitwise_count(keys[a] ^ keys[b]).sum(axis=1, dtype=np.int32) <= most)
                a, b = a[fine], b[fine]
                fine = (keys[a] == keys[b]).argmax(axis=1) == place[a]
                a, b = a[fine], b[fine]
                linked = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                a, b = a[linked], b[linked]
                np.add.at(n, a, run["copies"][b])
                np.add.at(n, b, run["copies"][a])
                while True:  # the links so far, joined with these
                    low = np.minimum(top[a], top[b])
                    if (top[a] == low).all() and (top[b] == low).all():
                        break
                    np.minimum.at(top, top[a].copy(), low)
                    np.minimum.at(top, top[b].copy(), low)
                    while (top[top] != top).any():
                        top = top[top]
            i = np.flatnonzero((n > 0) | (top != np.arange(len(x))))
            other = run["vec_id"][top[i]]
            yield pa.RecordBatch.from_arrays([pa.array(run["vec_id"][i]), pa.array(n[i]), pa.array(other, mask=other == run["vec_id"][i])], names=["vec_id", "n", "other"])

    whole = plain.unionByName(split).join(coded.select("vec_id", "code"), "vec_id").join(groups.select(F.col("rep").alias("vec_id"), "v", "copies"), "vec_id")
    return whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(verify, "vec_id long, n long, other long")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embeddings": op3_embeddings}
ORACLE_SQL: dict[str, str] = {}
