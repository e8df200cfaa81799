import math

import numpy as np

from clearpath.llm.vectordup import LEAST, Codebook, link_counts, op12_embedding_near_duplicates, unit


def brute(rows):
    """(vec_id, n_links, component_id, kept) of rows (vec_id, label, vector), by all pairs."""
    fine = [r[1] is not None and bool(r[2]) and all(c is not None and math.isfinite(c) for c in r[2]) and any(r[2]) for r in rows]
    links = {i: set() for i in range(len(rows))}
    for i in range(len(rows)):
        for j in range(i):
            if fine[i] and fine[j] and rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
                x, y = (np.array(rows[k][2], float) / max(map(abs, rows[k][2])) for k in (i, j))
                if float(x @ y) >= LEAST * math.sqrt(float(x @ x) * float(y @ y)):
                    links[i].add(j)
                    links[j].add(i)
    out, root = [], {}
    for i in links:
        if i not in root:
            todo, part = [i], {i}
            while todo:
                new = links[todo.pop()] - part
                part |= new
                todo += new
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            root |= {k: min(ids) if ids else None for k in part}
        out.append((rows[i][0], len(links[i]), root[i], rows[i][0] == root[i]))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=repr)


def near(rnd, v, cosine):
    """A vector at exactly this cosine from v, in a direction by chance."""
    w = rnd.normal(size=len(v))
    w -= v * (w @ v) / (v @ v)
    return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def made(rnd, d=24):
    rows = [(i, int(rnd.integers(3)), rnd.normal(size=d).tolist()) for i in range(300)]
    at = 1000
    for i in range(0, 300, 3):  # partners on either side of the limit, near it and far, of other lengths
        for cosine in (0.925, 0.931, 0.95, 0.99):
            rows.append((at, rows[i][1], (near(rnd, np.array(rows[i][2]), cosine) * rnd.uniform(0.1, 9)).tolist()))
            at += 1
    centre = rnd.normal(size=d)
    rows += [(3000 + i, 1, near(rnd, centre, 0.985).tolist()) for i in range(150)]  # a hot group of near copies
    rows += [(4000 + i, 1, rows[5][2]) for i in range(100)]  # copies
    rows += [(5000, 2, rows[5][2]), (5000, 2, rows[6][2])]  # another label; an id twice
    return rows


ODD = [(6000, None, [1.0] * 24), (6001, 1, None), (6002, 1, [0.0] * 24), (6003, 1, [math.nan] * 24), (6004, 1, [None, 1.0]), (6005, 1, [1.0, 2.0]), (6006, 1, [2.0, 4.0]), (6007, 1, []), (None, 1, [3.0, 6.0]), (6008, 2, [-0.0, 1e-300]), (6009, 2, [0.0, 1e300])]


def test_against_all_pairs(spark):
    rows = made(np.random.default_rng(7)) + ODD
    df = spark.createDataFrame([(*r, 1, b"x") for r in rows], "vec_id long, label int, embedding array<double>, list int, node binary").repartition(4)
    want = brute(rows)
    assert result(link_counts(df)) == want
    assert result(link_counts(df, region=24 * 40, queries=32, lists=64)) == want  # many regions, blocks and groups
    assert link_counts(df.limit(0)).count() == 0
    assert result(link_counts(df.filter("vec_id in (6001, 6002)"))) == [(6001, 0, 6001, True), (6002, 0, 6002, True)]


def test_labels_of_words_and_floats(spark):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.1]), (3, "b", [1.0, 0.0])]
    assert result(link_counts(spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>"))) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_probes_suffice():
    """Of every pair within reach one side probes the other's list."""
    rnd = np.random.default_rng(9)
    u = unit(rnd.normal(size=(4000, 16)))
    v = unit(np.array([near(rnd, x, rnd.uniform(LEAST, 1)) for x in u]))
    book = Codebook(u[:1000], 64, LEAST)
    near_u, near_v = u @ book.centroids.T, v @ book.centroids.T
    own_u, own_v = book.lists(near_u), book.lists(near_v)
    rows = np.arange(len(u))
    assert (book.probes(near_u, own_u)[rows, own_v] | book.probes(near_v, own_v)[rows, own_u]).all()
    assert book.probes(near_u, own_u).mean() < 0.9
    codes, error, said = book.codes(v, own_v)
    assert error.max() < 1 and codes.shape == (4000, 4)


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(op12_embedding_near_duplicates(spark, sf)) == brute(rows)
