import math

import numpy as np

from clearpath.llm.neighbours import K, hadamard, nearest, op8_nearest_neighbours


def brute(rows, queries, k):
    out = {}
    for qid, q in queries:
        s = sorted((-float((np.array(q, float) * np.array(v, float)).sum()), i) for i, v in rows if i != qid)
        out[qid] = [(i, -x) for x, i in s[:k]]
    return out


def result(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        own = got.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r.rank == len(own)
    return got


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], K)
    got = result(op8_nearest_neighbours(spark, sf))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.95
    vectors = dict(rows)
    for q, own in got.items():
        assert [x for x in own] == sorted(own, key=lambda x: (-x[1], x[0]))
        for i, s in own:
            assert i != q and math.isclose(s, float(np.dot(np.array(vectors[q], float), np.array(vectors[i], float))), rel_tol=0, abs_tol=1e-12)


def test_recall_on_many_vectors(spark):
    """Vectors by chance, the hardest there are: the share follows the data."""
    n, d = 200_000, 64
    made = lambda ids: np.stack([np.random.default_rng(int(i)).normal(size=d) for i in ids]).astype(np.float32)

    def rows(batches):
        for b in batches:
            yield b.rename(columns={"id": "vec_id"}).assign(embedding=list(made(b["id"])))

    df = spark.range(n, numPartitions=8).mapInPandas(rows, "vec_id long, embedding array<float>").persist()
    got = result(nearest(df, df.filter("vec_id % 2000 = 0")))
    every, hits = np.concatenate([made(range(a, a + 20_000)) for a in range(0, n, 20_000)]).astype(np.float64), 0
    for q in range(0, n, 2000):
        s = every @ every[q]
        s[q] = -np.inf
        hits += len({i for i, _ in got[q]} & set(np.argpartition(-s, K)[:K].tolist()))
    df.unpersist()
    assert hits / (len(got) * K) >= 0.9 and len(got) == 100


def test_exact_mode(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = result(nearest(df, df.filter("vec_id % 20 = 0"), share=1.0))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in brute(rows, [r for r in rows if r[0] % 20 == 0], K).items()}


def test_edges(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, (rnd.normal(size=5) * rnd.uniform(0.1, 3)).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(50)]  # copies: ties go to the smaller id
    odd = [(200, None), (201, [0.0] * 5), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [math.nan, 1.0, 1.0, 1.0, 1.0]), (204, [math.inf, 1.0, 1.0, 1.0, 1.0]), (205, []), (206, [1.0, 2.0]), (None, [1.0] * 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, cell int, t int").repartition(3)
    got = result(nearest(df, df.filter("vec_id % 20 = 0"), k=20))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    cut = result(nearest(df, df.filter("vec_id % 20 = 0"), k=20, region=40, group=2))  # regions of 8 vectors, split cells, 2 queries at a time
    assert {q: [i for i, _ in v] for q, v in cut.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    few = df.filter("vec_id in (0, 1, 2)")
    assert [len(v) for v in result(nearest(few, few)).values()] == [2, 2, 2]
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_transform_keeps_lengths():
    x = np.random.default_rng(1).normal(size=(4, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), np.linalg.norm(x, axis=1))
    assert np.allclose(hadamard(hadamard(x)), x)
