import numpy as np

from tessera.llm import crosspolytope as C


def test_rotations_keep_lengths():
    x = np.random.default_rng(0).normal(size=(7, 24))
    y = C.rotations(x, C.CrossPolytopeConfig(tables=3, hashes=2))
    assert y.shape == (7, 3, 2, 32) and np.allclose(np.linalg.norm(y, axis=-1), 1)


def test_first_probe_is_the_own_bucket():
    x = np.random.default_rng(1).normal(size=(50, 16))
    for h in (1, 2):
        c = C.CrossPolytopeConfig(tables=4, hashes=h, probes=9)
        p = C.probe_buckets(x, c)
        assert (p[:, :, 0] == C.own_buckets(x, c)).all()
        assert all(len(set(r)) == 9 for t in p for r in t)


def exact(rows, k):
    out = {}
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for i, q in ok:
        if i % 50 == 0:
            best = sorted({(-np.round(q @ v / np.linalg.norm(q) / np.linalg.norm(v), 12), j) for j, v in ok if j != i and len(v) == len(q)})
            out[i] = [(j, -s) for s, j in best[:k]]
    return out


def test_recall_ties_and_odd_rows(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(12, 24))
    x = (centres[r.integers(0, 12, 3000)] + r.normal(size=(3000, 24)) * 0.7).astype(np.float32)
    x[700:1500] = x[50]  # a hot vector: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3000, None), (3050, []), (3100, [0.0] * 24), (3150, [float("nan")] * 24), (3200, [None] * 24), (3250, [1.0, 2.0]), (None, x[0].tolist()), (100, x[100].tolist()), (3300, x[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for g in C.nearest(df, df.filter("vec_id % 50 = 0"), config=C.CrossPolytopeConfig(block=256)).orderBy("query_id", "rank").collect():
        got.setdefault(g.query_id, []).append((g.vec_id, g.score))
        assert g.rank == len(got[g.query_id])
    want = exact(rows, 5)
    want.pop(3250)
    assert got.keys() == want.keys()
    hits = [a[0] in {b[0] for b in got[q]} for q, w in want.items() for a in w]
    assert np.mean(hits) >= 0.95
    assert [j for j, _ in got[50]] == [700, 701, 702, 703, 704] and [j for j, _ in got[3300]] == [50, 700, 701, 702, 703]
    assert all(len(v) == 5 for v in got.values())
    assert C.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = {}
    for g in C.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(g.query_id, set()).add(g.vec_id)
    assert np.mean([j in got[q] for q, w in exact(rows, 5).items() for j, _ in w]) >= 0.9


def test_queries_with_few_rows_in_their_buckets_still_find_k(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(6, 64))
    pair = r.normal(size=16)
    far = r.normal(size=32)
    cluster = r.normal(size=32) + r.normal(size=(300, 32)) * 1e-3
    rows = [(50 * i, v.tolist()) for i, v in enumerate(x)] + [(1000, pair.tolist()), (1050, (-pair).tolist())]
    rows += [(2001 + i, v.tolist()) for i, v in enumerate(cluster)] + [(3000 + 50 * i, (s * far + r.normal(size=32) * 0.1).tolist()) for i, s in enumerate([1, -1, 1, -1])]
    rows += [(4001, (r.normal(size=8) * 0.01 + 1).tolist()) for _ in range(9)] + [(4001 + i, r.normal(size=8).tolist()) for i in range(1, 7)] + [(4050, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = exact(rows, 200)  # all rows: an id with several vectors is there several times
    for config in (C.CrossPolytopeConfig(), C.CrossPolytopeConfig(block=4)):
        got = {}
        for g in C.nearest(df, df.filter("vec_id % 50 = 0"), config=config).orderBy("query_id", "rank").collect():
            got.setdefault(g.query_id, []).append((g.vec_id, g.score))
        assert {q: len(v) for q, v in got.items()} == {q: min(5, len({j for j, _ in w})) for q, w in want.items()}
        for q in (0, 50, 100, 150, 200, 250):
            assert [j for j, _ in got[q]] == [j for j, _ in want[q]]
        assert [j for j, _ in got[1000]] == [1050] and abs(got[1000][0][1] + 1) < 1e-9
        assert len({j for j, _ in got[4050]}) == 5 and got[4050][0][0] == 4001
