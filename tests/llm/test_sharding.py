import hashlib
import zlib
from collections import defaultdict

import pytest
from marquee.llm import sharding as S


def brute(rows, shards):
    """Shards by trying capacities one after another."""
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.sha256((t or "").encode()).digest()] += len((t or "").encode()) + 1
    order = sorted(groups)

    def fill(c):
        out, n, at = {}, 0, 0
        for g in order:
            if at + groups[g] > c:
                n, at = n + 1, 0
            at += groups[g]
            out[g] = n
        return out if n < shards else None

    low, high = max(groups.values(), default=1), sum(groups.values()) + 1
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fill(mid) else (mid + 1, high)
    return low, fill(low)


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_against_brute_force(spark, shards):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(i + 5000, "the same text") for i in range(300)] + [(6000, None), (6001, ""), (6002, "é" * 9000), (None, "x"), (6002, "é" * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as end")
    got = S.shard_documents(df, shards).collect()
    cap, shard = brute(rows, shards)
    want = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), shard[hashlib.sha256((t or "").encode()).digest()]) for d, t in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard) for r in got) == want
    slots, filled = defaultdict(list), defaultdict(int)
    for r in got:
        slots[r.shard].append(r.slot)
        filled[r.shard] += r.size
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and max(filled.values()) <= cap


def test_empty_and_one_row(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    assert [tuple(r) for r in S.shard_documents(df).select("shard", "slot", "size").collect()] == [(0, 0, 2)]
    assert S.shard_documents(df.limit(0)).count() == 0
