import hashlib
import re
from collections import Counter, defaultdict

from marquee.llm import mixing as M

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """Targets and taken words by the definition."""
    sized = [(d, s, len(WORDS.findall(t or ""))) for d, t, s in rows]
    total = Counter()
    for _, s, n in sized:
        total[s] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * total[s]}
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        free -= over
    luck = lambda d: hashlib.md5(f"mix-1|doc|{'~' if d is None else d}".encode()).hexdigest()
    out, at = [], defaultdict(int)
    for d, s, n in sorted(sized, key=lambda r: (r[1] or "", luck(r[0]))):
        words = round(target[s])
        taken = sum(max(0, min(n, words - total[s] * e - at[s])) for e in range(2))
        at[s] += n
        out.append((d, n, total[s], round(target[s], 6), taken))
    return sorted(out, key=str), target


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in docs.collect()] + [(7001, None, "src3"), (7002, "a b c", None), (7003, "", None), (7004, "only one source", "zz"), (None, "no id here", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as row", "3 as block")
    pieces = M.mix_sources(df, shards=5, blocks_per_shard=7)
    pieces = [r.asDict() for r in pieces.collect()]
    per = defaultdict(int)
    for p in pieces:
        per[p["row"], p["doc_id"], p["size"], p["source_size"], round(p["target"], 6)] += p["n_words"]
    got = sorted(((k[1], k[2], k[3], k[4], v) for k, v in per.items()), key=str)
    want, target = brute(rows)
    assert got == want
    assert all(v <= 2 * k[2] for k, v in per.items())
    owner, by_shard = {}, Counter()
    for p in pieces:
        if p["block"] is not None:
            assert owner.setdefault((p["source"], p["block"]), (p["shard"], p["place"])) == (p["shard"], p["place"])
    for (_, _), (shard, _) in owner.items():
        by_shard[shard] += 1
    assert set(by_shard) == set(range(5)) and max(by_shard.values()) - min(by_shard.values()) <= 3
    assert len({v for v in owner.values()}) == len(owner)


def test_documents_and_empty(spark):
    rows = [(i, f"w{i} " * (i % 5 + 1), f"s{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    n = Counter(r.doc_id for r in out.collect())
    assert max(n.values()) <= 2 and sum(n.values()) > 60
    assert M.mixed_documents(df.limit(0)).count() == 0 and M.mix_sources(df.limit(0)).count() == 0


def test_split_is_exact(spark):
    q = spark.createDataFrame([(0, 40), (1, 7), (2, 1)], "rank long, quota long")
    rows = M.split_quotas(q, 6).collect()
    assert Counter(r["rank"] for r in rows for _ in range(r.blocks)) == {0: 40, 1: 7, 2: 1}
    per = Counter()
    for r in rows:
        per[r.shard] += r.blocks
    assert set(per.values()) == {8}


def test_rows_that_share_an_id_meet_the_target(spark):
    """Copies of rows with one id, or none, are those of their own pieces, whatever the columns are called."""
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (1, "g", "x"), (None, "h i", "y"), (None, "j k l", "y"), (7, "m n o p", "y"), (1, "q r", None), (8, None, "x"), (8, "", "x")]
    rows += [(9, "hot word", "x")] * 50
    df = spark.createDataFrame([(i, t, s, 1, 2, "z") for i, t, s in rows], "doc_id long, text string, source string, row long, times long, `d` string")
    pieces = M.mix_sources(df).groupBy("row", "doc_id", "source", "size").sum("n_words").collect()
    want = sorted(str((r[1], r[2], r[3])) for r in pieces if r[3] for _ in range(int(r[4] / r[3] + 0.5)))
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    got = sorted(str((r.doc_id, r.source, len((r.text or "").split()))) for r in out.collect())
    assert got == want and len(got) > 50


def test_long_texts_and_repeated_rows(spark):
    rows = [(i % 3, "w " * (20000 if i == 0 else 5), "abc"[i % 3]) for i in range(30)]
    out = M.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len({r.row for r in out}) == 30
    taken = {}
    for r in out:
        taken[r.source] = taken.get(r.source, 0) + r.n_words
    assert all(abs(taken[r.source] - r.target) <= 1 for r in out)
