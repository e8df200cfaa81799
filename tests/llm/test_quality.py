import math
from collections import Counter

import numpy as np
import pytest

from clearpath.llm.quality import BUCKETS, SMOOTHING, SPREADS, _count, filter_quality, fit_ratio, marked_documents, op6_quality_rules, quality_rules, ratio_table, trusted_scores

from .oracle import run_sql

SF = "/root/testdata/sf0.001"
BASE = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
l AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM w) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
d AS (SELECT doc_id, count(*) - count(DISTINCT line) AS dup FROM l GROUP BY doc_id),
p AS (SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS seen FROM p),
c AS (SELECT doc_id, count(DISTINCT i + k) AS covered FROM g, (SELECT unnest([0, 1, 2]) AS k) WHERE seen > 1 GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum([len(x) for x in words]), 0)::BIGINT AS word_chars,
  len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(covered, 0)::BIGINT AS n_repeat_words,
  len(words) < 50 OR 100 * coalesce(covered, 0) > 50 * len(words) AS base_failed
FROM w LEFT JOIN d USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def brute(docs, trusted, threshold=None):
    """Score and verdict of each text by plain counting; ``trusted``: ids."""

    def grams(text):
        b = text.encode()
        return [((int.from_bytes(b[i : i + 4], "little") * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(b) - 3)]

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t or ""))
        if d in trusted:
            target.update(grams(t or ""))
    n, m = sum(raw.values()), sum(target.values())
    ratio = {}
    for g in raw:
        p = (raw[g] + 1) / (n + BUCKETS)
        ratio[g] = math.log((target[g] + SMOOTHING * p) / (m + SMOOTHING) / p)
    score = [sum(ratio[g] for g in grams(t or "")) / max(1, len(grams(t or ""))) for _, t in docs]
    if threshold is None:
        own = sorted(s for s, (d, t) in zip(score, docs, strict=True) if d in trusted and t)
        at = lambda q: own[max(0, math.ceil(q * len(own)) - 1)]
        threshold = at(0.5) - SPREADS * (at(0.5) - at(0.01)) if own else -math.inf
    return score, threshold


def test_base_columns_against_sql(spark):
    names, want = run_sql(BASE, SF)
    got = [tuple(r[n] for n in names) for r in op6_quality_rules(spark, SF).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_score_and_verdict_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.quality == 1}
    score, threshold = brute(docs, trusted)
    got = {r.doc_id: r for r in op6_quality_rules(spark, SF).collect()}
    for (d, _), s in zip(docs, score, strict=True):
        assert got[d].llr == pytest.approx(s, abs=1e-6)
        if abs(s - threshold) > 1e-6:
            assert got[d].kept == (not got[d].base_failed and s >= threshold)


def edges(spark):
    rnd = np.random.default_rng(3)
    word = lambda: "".join(rnd.choice(list("aeiourstlnm"), int(rnd.integers(2, 8))))
    rows = [(i, " ".join(word() for _ in range(120))) for i in range(60)]
    rows += [(100 + i, " ".join("".join(rnd.choice(list("#$%&0123456789"), 9)) for _ in range(120))) for i in range(5)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "same three words " * 60), (205, " ".join(word() for _ in range(60_000))), (206, "\n".join(["a line of words"] * 30))]
    rows += [(7, rows[7][1]), (7, "another text"), (None, rows[3][1]), (None, None)]
    df = spark.createDataFrame([(*r, True, 1.0, "x") for r in rows], "doc_id long, text string, kept boolean, llr double, bucket string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(i, 1, 0) for i in range(5)] + [(None, 1, 0), (100, 0, 0), (101, None, 0)], "doc_id long, quality int, toxic int")
    return rows, df, labels


def test_edges(spark):
    rows, df, labels = edges(spark)
    got = quality_rules(df, labels).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].kept for i in range(60) if i != 7)
    assert sorted(r.kept for r in by[7]) == [False, True, True]  # each row by itself
    assert not any(r.kept for i in range(100, 105) for r in by[i])
    for i in (200, 201, 202):
        assert (by[i][0].n_words, by[i][0].word_chars, by[i][0].base_failed, by[i][0].kept) == (0, 0, True, False)
    assert by[205][0].n_words == 60_000 and not by[205][0].base_failed
    assert by[204][0].n_repeat_words == 180 and by[204][0].base_failed
    assert by[206][0].n_dup_lines == 29
    kept = filter_quality(df, labels)
    assert kept.columns == df.columns
    want = sorted((r.doc_id for r in got if r.kept), key=str)
    assert sorted((r.doc_id for r in kept.collect()), key=str) == want


def test_without_rows_or_trust(spark):
    rows, df, labels = edges(spark)
    assert quality_rules(df.limit(0), labels).collect() == []
    got = quality_rules(df, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in got) and any(r.kept for r in got)



def test_all_trusted_documents_count(spark):
    """However many documents are trusted, each one's n-grams are in the target."""
    n = 20_500  # more than were once sampled
    df = spark.range(n).selectExpr("id as doc_id", "concat('abcd', lpad(cast(id as string), 6, '0')) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality")
    (counts,) = _count([df.toPandas().assign(trusted=True)])
    every = np.zeros(BUCKETS)
    every[counts["bucket"]] = counts["raw"]
    assert np.allclose(fit_ratio(df, labels), ratio_table(every, every))


def test_one_shuffle_of_text(spark):
    """At any size: texts are shuffled for the counts only, and scores without them."""
    rows, df, labels = edges(spark)
    marked = marked_documents(df, labels)
    plan = lambda d: d._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan(marked) and "Broadcast" not in plan(marked)
    assert sorted(((r.text, r.trusted) for r in marked.collect()), key=str) == sorted(((t, d is not None and d < 60) for d, t in rows), key=str)
    own = plan(trusted_scores(df, labels, np.zeros(BUCKETS)))
    assert -1 < own.index("SortMergeJoin") < own.index("MapInPandas") and "Broadcast" not in own
    # Rows without an id do not meet in one task.
    alone = spark.range(500).selectExpr("cast(null as long) as doc_id", "concat('text ', id) as text")
    sizes = marked_documents(alone, labels).rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    assert sum(sizes) == 500 and (len(sizes) == 1 or max(sizes) < 500)
