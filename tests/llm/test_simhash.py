import numpy as np
import xxhash
from marquee.llm import simhash as S


def brute(rows):
    """Fingerprints and classes by the definition, all pairs."""
    prints = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and comp[j] > comp[i]:
                    comp[j], changed = comp[i], True
    ids = {}
    for c, (d, _) in zip(comp, rows):
        ids[c] = min([x for x in (ids.get(c), d) if x is not None], default=None)
    return sorted((str(d), f"{p:016x}", str(ids[c])) for (d, _), p, c in zip(rows, prints, comp))


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    rows += [(9001, None), (9002, ""), (9003, " \n"), (9004, "One two"), (9005, "one TWO"), (None, rows[0][1]), (rows[3][0], rows[3][1]), (9006, "long word " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component", "3 as key")
    got = S.near_duplicates(df).selectExpr("doc_id", "lower(lpad(hex(fp),16,'0')) fp", "component_id").collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_trie_pairs_and_hot_groups(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, k, dtype=np.uint64)) for b in base[:8] for k in rng.integers(1, 6, 60)]
    codes = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if int(codes[i] ^ codes[j]).bit_count() <= 3}
    a, b = S.trie_pairs(codes, np.array([0]), np.array([len(codes)]), 3, 63)
    assert {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())} == want
    comp = list(range(len(codes)))
    for _ in codes:
        for i, j in want:
            comp[i] = comp[j] = min(comp[i], comp[j])
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    for leaf in (4, 16, 1000):
        got = {r.node: r.component for r in S.components(S.trie_links(df, leaf=leaf)).collect()}
        sets = {}
        for x, c in got.items():
            sets.setdefault(c, set()).add(x)
        expect = {}
        for x, c in zip(codes.view(np.int64).tolist(), comp):
            expect.setdefault(c, set()).add(x)
        assert sorted(map(sorted, sets.values())) == sorted(sorted(s) for s in expect.values() if len(s) > 1), leaf


def brute_similar(rows, words=5, least=0.8):
    """Linked pairs of rows by the definition."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets.append({b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {b" ".join(w)} if w else set())
    same = lambda x, y: x == y if not x or not y else len(x & y) >= least * len(x | y)
    return {(i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if same(sets[i], sets[j])}


def test_similar_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    long = [(d, t) for d, t in rows if t and len(t.split()) > 80][:20]
    for k, (_, t) in enumerate(long):
        for m in (1, 2, 4, 8, 16):
            w = t.split()
            for i in rng.integers(0, len(w), max(1, len(w) * m // 400)):
                w[i] = f"x{i}"
            rows.append((8000 + 10 * k + m, " ".join(w)))
    rows += [(9001, None), (9002, ""), (9004, "One two"), (9005, "one TWO"), (None, long[0][1]), (rows[3][0], rows[3][1]), (9006, "long word " * 30000)]
    df = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(rows)], "row long, doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df, id_col="row").collect()}
    want = brute_similar(rows)
    comp = list(range(len(rows)))
    for _ in rows:
        for i, j in sorted(want):
            comp[i] = comp[j] = min(comp[i], comp[j])
    assert all(comp[i] == comp[c] for i, c in got.items()), "linked what is not similar"
    met = sum(got[i] == got[j] for i, j in want)
    assert met >= 0.95 * len(want), (met, len(want))
    kept = S.keep_one(df.selectExpr("*", "1 as d", "2 as own", "3 as n", "4 as node"), id_col="row")
    assert kept.columns == ["row", "doc_id", "text", "d", "own", "n", "node"]
    assert sorted(r.row for r in kept.collect()) == sorted(set(got.values()))


def test_similar_links_every_pair_at_the_threshold(spark):
    """Pairs that reach the threshold, by sets of words only just: none is left out, and none below it links."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(400):
        w = [f"w{i}" for i in rng.integers(0, 3000, 204)]
        v = list(w)
        # Each word put in the place of another costs 5 of 200 shingles on each side: 4 give 180 of 220, 5 give 175 of 225.
        for i in 10 + 40 * np.arange(4 + k % 2):
            v[i] = f"v{k}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    df = spark.createDataFrame([(d if d else None, t) for d, t in rows], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_documents(df).collect()}
    # The row without an id is linked by its text.
    want = {d: d if d % 4 in (2, 3) else max(d // 2 * 2, 1) for d, _ in rows if d}
    assert {d: c for d, c in got.items() if d is not None} == want and got[None] == 1


def test_prefix_pairs_in_chunks(spark):
    """Sets that all share frequent shingles: pairs of different components that can reach the similarity, whatever the size of a leaf."""
    rows = [(k, 10, [7, 100 + k // 2, 50], k // 4) for k in range(200)] + [(900, 13, [7, 50, 3], 900), (901, 10, [7, 1, 2], 901)]
    heads = spark.createDataFrame(rows, "node long, n long, prefix array<long>, component long")
    want = {(a, b) for a in range(200) for b in range(a + 1, 200) if a // 4 != b // 4}
    for leaf in (8, 1024):
        assert {(r.a, r.b) for r in S.prefix_pairs(heads, 0.8, leaf).collect()} == want, leaf


def test_similar_large_group_in_chunks(spark):
    """A group of near copies that all trees split: one class whatever the size of a leaf."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(400)]
    rows = [(-1, " ".join(f"v{i}" for i in range(300)))]
    for k in range(150):
        w = list(base)
        for i in rng.integers(0, 400, 3):
            w[i] = f"y{k}"
        rows.append((k, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in S.similar_documents(df.filter("doc_id >= 0")).collect()} == {0}
    codes = S.stored(df.select("doc_id", "text")).count()
    assert codes == 151


def test_parity_never_overstates():
    """Differing bits are no more than the shingles in which two sets differ, also where one is folded."""
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (1, 40, 511, 512, 513, 900, 3000)]
    sets += [np.unique(np.concatenate([x[: len(x) * 9 // 10], rng.integers(0, 1 << 63, len(x) // 7 + 1, dtype=np.uint64)])) for x in sets]
    marks = [S.parity(x) for x in sets]
    i, j = np.triu_indices(len(sets), 1)
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    for at_once in (64, 1 << 24):
        got = S.least_apart(marks, i, j, at_once)
        assert (got <= true).all() and (got[true > 100] > 40).all()


def test_prefix_links_connect_what_pairs_do(spark):
    """Links of prefixes against all pairs by the definition, whatever the size of a leaf."""
    rng = np.random.default_rng(21)
    sets = []
    for _ in range(12):
        base = np.unique(rng.integers(1, 1 << 62, 60))
        for m in (0, 3, 5, 7, 9, 12):
            sets.append(np.sort(np.concatenate([rng.permutation(base)[m:], rng.integers(1, 1 << 62, m)])))
    none = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    prefixes = [S.prefix(x.view(np.uint64), none, 0.8).view(np.int64).tolist() for x in sets]
    component = [k if k % 6 > 1 else k // 6 * 6 for k in range(len(sets))]
    rows = [(k, len(x), p, c, S.parity(x.view(np.uint64))) for k, (x, p, c) in enumerate(zip(sets, prefixes, component))]
    heads = spark.createDataFrame(rows, "node long, n long, prefix array<long>, component long, parity binary")
    lists = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(sets)], "node long, set array<long>")

    def classes(links):
        label = list(component)
        for _ in sets:
            for a, b in links:
                label[a] = label[b] = min(label[a], label[b])
            low = {}
            for k, x in enumerate(label):
                low[component[k]] = min(low.get(component[k], x), x)
            label = [low[component[k]] for k in range(len(sets))]
        return label

    like = {(a, b) for a in range(len(sets)) for b in range(a + 1, len(sets)) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
    assert classes(like) != component
    for leaf in (4, 1024):
        got = {(min(r), max(r)) for r in S.prefix_links(heads, 0.8, lambda nodes: S.stored(lists.join(nodes, "node")), leaf).collect()}
        assert got <= like and classes(got) == classes(like), leaf


def test_similar_rows_follow_the_size_of_a_group(spark, monkeypatch):
    """Texts that are all nearly, but none is quite, similar: links that are stored grow with the texts, not with their pairs."""
    base = [f"w{i}" for i in range(204)]
    rows = []
    for a in range(13):
        for b in range(13):
            w = list(base)
            for slot in (a, 13 + b, 26 + (a + b) % 13):
                w[4 + 5 * slot] = f"v{a} {b}".replace(" ", "x")
            rows.append((13 * a + b, " ".join(w)))
    made, keep = [], S.stored

    def counted(df, *more):
        out = keep(df, *more)
        made[-1] += out.count() if df.columns == ["a", "b"] else 0
        return out

    monkeypatch.setattr(S, "stored", counted)
    for n in (84, 168):
        made.append(0)
        got = S.similar_documents(spark.createDataFrame(rows[:n], "doc_id long, text string")).collect()
        assert all(r.doc_id == r.component_id for r in got) and len(got) == n
    assert made[0] > 0 and made[1] <= 3 * made[0], made


def test_nearest_forest():
    a, b, d = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4]), np.array([5, 1, 2, 7])
    assert sorted(S.nearest_forest(5, a, b, d).tolist()) == [1, 2, 3]


def test_similar_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.similar_documents(df).count() == 0 and S.keep_one(df).count() == 0


def test_keep_one_judges_rows_that_share_an_id_by_their_texts(spark):
    """Each class keeps one row, whatever other texts its id has in other classes."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(3, a), (5, a), (5, b), (6, b + " end"), (6, c), (8, c), (10, a), (10, b), (5, d), (11, d), (12, "x y"), (12, "X y"), (12, "x y"), (13, None), (13, "z")]
    df = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row long, doc_id long, text string")
    got = sorted((r.doc_id, (r.text or "").lower()) for r in S.keep_one(df).collect())
    assert got == [(3, a), (5, b), (5, d), (6, c), (12, "x y"), (13, ""), (13, "z")]


def test_links_in_one_partition_need_no_rounds(spark, monkeypatch):
    """A driver plans and follows each round of jobs, so links that one task can contract take a single stored table."""
    from marquee.llm import common

    tables = []
    monkeypatch.setattr(common, "stored", lambda df, write=common.stored: tables.append(write(df)) or tables[-1])
    chain = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 1001), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(chain).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert len(tables) == 1


def test_components_over_many_partitions(spark):
    from marquee.llm import common

    rng = np.random.default_rng(4)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    df = spark.createDataFrame(links, "a long, b long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = common.contracted(df.filter("a <> b").selectExpr("a as u", "b as v").repartition(4), most=20)
        assert not common.are_stars(parts)
        got = {r.node: r.component for r in common.components(df).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    nodes = sorted({x for link in links if link[0] != link[1] for x in link})
    at = np.searchsorted(nodes, [link for link in links if link[0] != link[1]])
    top = common.forest(len(nodes), at[:, 0], at[:, 1])
    assert got == {n: nodes[t] for n, t in zip(nodes, top)}
