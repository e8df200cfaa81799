import math

import numpy as np

from clearpath.llm.whitening import op11_embedding_whitening, whiten


def brute(rows):
    """x of the rows that take part, the fit list, its covariance's eigenvalues and -vectors."""
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = max(len(v) for _, v in kept)
    kept = [(i, v) for i, v in kept if len(v) == d]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * c - s for c, s in zip(v, sums, strict=True)] for v in fit], float) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def held(got, rows, components=16):
    kept, n, sums, values, vectors = brute(rows)
    k = min(components, len(values))
    assert len(got) == len(kept) * k
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    signs = {}
    for i, x in kept:
        off = [n * c - s for c, s in zip(x, sums, strict=True)]
        own = sorted((r for r in by_id[i]), key=lambda r: r.component)
        assert {r.component for r in own} == set(range(1, k + 1))
        for r in own:
            want = float(np.array(off, float) / n @ vectors[:, r.component - 1] / math.sqrt(values[r.component - 1]))
            sign = signs.setdefault(r.component, 1 if abs(r.whitened - want) < abs(r.whitened + want) else -1)
            assert math.isclose(r.whitened, sign * want, rel_tol=1e-7, abs_tol=1e-7)
            assert r.n == n and r.deviation == sum(o * o for o in off)
            assert math.isclose(r.explained, values[r.component - 1] / values.sum(), rel_tol=1e-9)
            assert r.identity_error < 1e-9
    assert all(math.isfinite(r.whitened) for r in got)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    held(op11_embedding_whitening(spark, sf).collect(), rows)


def test_edges(spark):
    rnd = np.random.default_rng(5)
    rows = [(i, rnd.normal(size=5).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)]  # copies count once in the fit
    odd = [(2000, None), (2001, []), (2002, [1.0, None, 0.0, 0.0, 0.0]), (2003, [math.nan] * 5), (2004, [math.inf, 0.0, 0.0, 0.0, 0.0]), (2005, [1.0, 2.0]), (None, [0.5] * 5), (2006, [-0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows + odd], "vec_id long, embedding array<double>, x int, component int").repartition(4)
    held(whiten(df).collect(), rows + odd)
    held(whiten(df, 2).collect(), rows + odd, 2)
    assert whiten(df.limit(0)).count() == 0
    assert whiten(df.filter("vec_id in (2000, 2001)")).count() == 0


def test_without_variance(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    got = whiten(one).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, None, None, None)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(50)], "vec_id long, embedding array<double>")
    got = whiten(line).collect()
    assert all((r.whitened is None) == (r.component == 2) for r in got) and len(got) == 100


def test_numbers_beyond_a_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-3e15, 1.0]), (3, [2e15, 3.0])]
    got = {(r.vec_id, r.component): r for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == 6 and all(r.deviation is None for r in got.values())
    assert all(math.isfinite(r.whitened) for r in got.values() if r.whitened is not None)
