import numpy as np
import pytest
from marquee.llm import embeddings as E


def brute(rows, threshold=0.9):
    """All pairs."""
    ok = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    comp = {i: i for i in range(len(rows))}
    n = dict.fromkeys(comp, 0)
    x = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in ok}
    pairs = [(i, j) for i in ok for j in ok if i < j and len(x[i]) == len(x[j]) and x[i] @ x[j] >= threshold - 1e-12]
    for i, j in pairs:
        n[i] += 1
        n[j] += 1
    ident = {i: rows[i][0] for i in comp}
    for _ in rows:
        before = dict(ident)
        for i, j in pairs:
            ident[i] = ident[j] = min(ident[i], ident[j])
        if before == ident:
            break
    return sorted((str(rows[i][0]), n[i], str(ident[i])) for i in comp)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_against_brute_force(spark, chunk):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 24))
    rows, i = [], 0
    for c in centres:
        for _ in range(rng.integers(1, 12)):
            rows.append((i, (c + rng.standard_normal(24) * 0.15).astype(np.float32).tolist()))
            i += 3
    hub = rng.standard_normal(24)
    rows += [(i + 3 * k, (hub + rng.standard_normal(24) * 0.05).astype(np.float32).tolist()) for k in range(120)]
    same = rows[5][1]
    rows += [(5000 + k, same) for k in range(40)]
    rows += [(6000, None), (6001, []), (6002, [0.0] * 24), (6003, [None] + [1.0] * 23), (6004, [float("nan")] * 24), (6005, [float("inf")] * 24), (6006, [2 * x for x in same]), (6007, same[:3]), (6008, same[:3]), (None, same), (6000, None), rows[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as rep", "3 as code")
    got = E.near_vectors(df, chunk=chunk, recall=0.9999).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)


def test_recall_on_table(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    rng = np.random.default_rng(2)
    for k in range(300):  # partners right at the threshold
        v = np.array(rows[k][1], float)
        w = rng.standard_normal(64)
        w -= (w @ v) * v / (v @ v)
        a = np.arccos(0.905)
        rows.append((10000 + k, (np.cos(a) * v / np.linalg.norm(v) + np.sin(a) * w / np.linalg.norm(w)).tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sum(r.n_links for r in E.near_vectors(df).collect())
    want = sum(r[1] for r in brute(rows))
    assert 0.9 * want <= got <= want and want >= 600


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_vectors(df).count() == 0
    assert E.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()[0].n_links == 0
