import random
import re

import pytest

from clearpath.llm.neardup import drop_near_duplicates, near_duplicates
from clearpath.llm.shingles import HASHES, band_rows


def brute(rows, percent, size):
    """doc_id, n_shingles, component and kept; ids are unique and not null."""

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()

    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        return i if comp[i] == i else root(comp[i])

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                comp[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("size", "percent"), [(5, 80), (1, 90), (3, 80)])
def test_sizes_against_brute_force(spark, size, percent):
    rnd = random.Random(size)
    words = [f"w{i}" for i in range(500)]
    texts = ["", "a", "a b", "b a", "a b c", "a b c d", "a b c d e", "a b c d e f", "a b c d e"]
    for n in (60, 100, 150, 300):
        base = [rnd.choice(words) for _ in range(n)]
        for _ in range(25):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5])):
                t[rnd.randrange(n)] = rnd.choice(words)
            texts.append(" ".join(t + [rnd.choice(words) for _ in range(rnd.choice([0, 0, n // 6, n // 4]))]))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(tuple(r) for r in near_duplicates(df, percent, size).collect()) == brute(rows, percent, size)


def test_a_copy_with_a_block_appended_goes(spark):
    text = " ".join(f"w{i}" for i in range(1000))
    longer = text + " " + " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(1, text), (2, longer)], "doc_id long, text string")
    assert [r.doc_id for r in drop_near_duplicates(df).collect()] == [1]
    assert [r.kept for r in near_duplicates(df).collect()] == [True, True]  # 3 words, 85 %


def test_a_copy_with_scattered_changes_goes(spark):
    words = [f"w{i}" for i in range(1000)]
    changed = ["x" if i % 40 == 20 else w for i, w in enumerate(words)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(changed))], "doc_id long, text string")
    assert [r.doc_id for r in drop_near_duplicates(df).collect()] == [1]
    assert [r.kept for r in near_duplicates(df, 80, 5).collect()] == [True, True]


def test_a_pair_at_the_limit_shares_a_band():
    assert [band_rows(s) for s in (0.85, 0.80)] == [6, 5]
    for percent in (50, 70, 80, 85, 95):
        r = band_rows(percent / 100)
        assert (1 - (percent / 100) ** r) ** (HASHES // r) <= 3e-7


def test_another_text_under_the_id_of_a_copy_stays(spark):
    rows = [(1, "a b c d e f g"), (2, "A b  c d e f g"), (2, "no other row has this text"), (3, "a b c d e f g"), (3, None), (3, ""), (4, "no other row has this text")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, gone_id string")
    got = sorted(((r.doc_id, r.text) for r in drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([rows[0], rows[2], rows[4], rows[5]], key=str)
