import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from clearpath.llm.language import DIMS, filter_language, fit, fold, language_id, letters, op7_language_id


def toy(spark, extra=()):
    rnd = random.Random(4)
    parts = {"xx": ["ka", "mo", "ti", "lu", "ra", "pe"], "yy": ["sch", "ung", "ein", "ver", "der", "lich"], "zz": ["ção", "ñar", "ées", "où", "él", "ça"]}
    word = lambda lang: "".join(rnd.choice(parts[lang]) for _ in range(rnd.randint(2, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rnd.randint(30, 120))), lang) for i in range(300) for lang in [("xx", "yy", "zz")[i % 3]]]
    rows += list(extra)
    return rows, spark.createDataFrame([(*r, "s", 0.5, True) for r in rows], "doc_id long, text string, lang string, source string, score double, rejected boolean").repartition(3)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op7_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.99 * len(held)


def test_nearest_centroid_against_brute_force(spark):
    rows, df = toy(spark)
    learnable = fold(df).filter("not held_out")
    model = fit(learnable)
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]

    def grams(text):
        out = {}
        b = letters(text).encode()
        for i in range(len(b) - 2):
            g = ((int.from_bytes(b[i : i + 3], "little") * 2654435761) & 0xFFFFFFFF) >> (32 - int(math.log2(DIMS)))
            out[g] = out.get(g, 0) + 1
        return out

    seen = {}
    for _, t, _ in learned:
        for g in grams(t):
            seen[g] = seen.get(g, 0) + 1
    idf = lambda g: math.log((1 + len(learned)) / (1 + seen.get(g, 0))) + 1
    got = {r.doc_id: r for r in language_id(df).collect()}
    for d, t, _ in rows[:60]:
        v = {g: math.log1p(n) * idf(g) for g, n in grams(t).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        cosine = [sum(x / norm * float(c[g]) for g, x in v.items()) for c in model.centres]
        best = int(np.argmax(cosine))
        assert got[d].lang_pred == model.langs[best] and abs(got[d].score - max(0.0, cosine[best])) < 1e-4


def test_foreign_text_is_rejected(spark):
    odd = [(1000, "Съешь же ещё этих мягких французских булок " * 8, None), (1001, "これは日本語の文章です。" * 30, None), (1002, " ".join("qjxvz wqkpj zzxqw" for _ in range(40)), None)]
    rows, df = toy(spark, odd)
    got = {r.doc_id: r for r in language_id(df).collect()}
    assert [got[d].rejected for d in (1000, 1001, 1002)] == [True] * 3
    assert not any(got[d].rejected for d, _, lang in rows if lang)
    kept = filter_language(df)
    assert kept.columns == df.columns
    assert {r.doc_id: r.lang for r in kept.collect()} == {d: lang for d, _, lang in rows if lang}


def test_edges(spark):
    base, _ = toy(spark)
    extra = [(2000, None, "xx"), (2001, "", "yy"), (2002, "12 34 -- 5", "zz"), (2003, base[0][1], None), (None, base[1][1], "yy"), (5, base[2][1], "zz"), (5, base[2][1], "zz"), (2004, (base[1][1] + " ") * 400, "yy")]
    extra += [(7, base[0][1], "xx")] * 50  # one id and text many times: still one text of the sample
    rows, df = toy(spark, extra)
    got = language_id(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for d in (2000, 2001, 2002):
        assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
    assert by[2003].lang_pred == "xx" and by[2004].lang_pred == "yy"
    assert by[None].held_out is None and by[None].lang_pred == "yy"
    assert language_id(df.limit(0)).collect() == []
    assert {r.lang_pred for r in language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
