import random

from clearpath.llm.components import connected_components
from clearpath.llm.neardup import drop_near_duplicates, near_duplicates


def brute(rows, percent=85):
    import re

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()

    sets = [shingles(t) for _, t in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def make_rows():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(500)] + ["É", "ß", "the", "THE"]
    base = [[rnd.choice(words) for _ in range(n)] for n in (120, 150, 90, 400, 3, 2, 1)]
    rows = []
    for b in base:
        for copies in range(40):
            t = list(b)
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 6]) if len(b) > 3 else 0):
                t[rnd.randrange(len(t))] = rnd.choice(words)
            rows.append(" ".join(t) if copies % 3 else "  ".join(t).upper())
    rows += ["", None, " \n", "a", "A", "É", "é", "x y", "X  Y", "x y z", "word " * 3000, "word " * 2999]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    rows = list(zip(ids, rows, strict=True))
    return rows + [rows[3], (rows[4][0], "another text under a known id here"), (None, "only null ids hold this text now"), (None, rows[7][1])]


def test_against_brute_force(spark):
    rows = make_rows()
    df = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, node int, bands int, cluster int, a int").repartition(4)
    got = sorted((tuple(r) for r in near_duplicates(df).collect()), key=str)
    want = brute(rows)
    # a null id alone: component null, kept true
    want = sorted(((d, n, c, True if d is None and c is None else k) for d, n, c, k in want), key=str)
    assert got == want


def test_one_of_each_group_stays(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (7, "other words here"), (9, None), (9, None), (None, "a b c d"), (8, "")]
    df = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, "A b c d"), (7, "other words here"), (9, None), (None, "a b c d"), (8, "")], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert near_duplicates(df).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}
