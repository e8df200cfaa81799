import random
import zlib

import numpy as np

from clearpath.llm.toxicity import PATTERNS, coded, document_values, landmark_features, norms, op4_toxicity, score_toxicity, item_values


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = op4_toxicity(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    hit = sum(r.predicted and labels[r.doc_id] for r in held)
    assert hit / sum(labels[r.doc_id] for r in held) > 0.8 and hit / sum(r.predicted for r in held) > 0.75


def toy(spark):
    rnd = random.Random(2)
    syl = ["ta", "ri", "mo", "lu", "ken", "sa", "vo", "pel", "dra", "ni"]
    word = lambda: "".join(rnd.choice(syl) for _ in range(rnd.randint(1, 3)))
    docs, labels = [], []
    for i in range(300):
        text = [word() for _ in range(rnd.randint(20, 60))]
        if i % 4 == 0:
            for _ in range(3):
                text.insert(rnd.randrange(len(text)), rnd.choice(["gruzbik", "gruzbiks", "fwexy"]))
        docs.append((i, " ".join(text), 1, 2))
        labels.append((i, 1, int(i % 4 == 0)))
    more = [("gru-zbik", 1), ("gruzzbik", 1), ("talu g r u z b i k sa", 1), ("GRUZBIK!", 1), ("talu rimo sa", 0), ("", 0), (None, 0), ("x" * 5000, 0), (" ".join(["talu"] * 20000) + " gruzbik", 1)]
    docs += [(1000 + i, t, 1, 2) for i, (t, _) in enumerate(more)] + [(None, "gruzbik", 1, 2), (7, "gruzbik", 1, 2), (7, "gruzbik", 1, 2)]
    return spark.createDataFrame(docs, "doc_id long, text string, toxic int, value int").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), more


def test_gapped_and_inserted_characters(spark):
    docs, labels, more = toy(spark)
    got = score_toxicity(docs, labels).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == docs.count()
    worst = min(by[1000 + i].score for i, (_, y) in enumerate(more) if y)
    clean = sorted(by[i].score for i in range(300) if i % 4 and i != 7)
    assert worst > clean[int(0.97 * len(clean))]
    assert [by[1000 + i].predicted for i in (2, 3, 8)] == [1, 1, 1]
    assert not any(by[1000 + i].predicted for i, (_, y) in enumerate(more) if not y)
    assert by[None].held_out is None and by[None].predicted == 1
    assert score_toxicity(docs.limit(0), labels).count() == 0
    assert {r.score for r in score_toxicity(docs, labels.limit(0)).collect()} == {0.0}


def test_folded_machine_equals_kernel():
    marks, words = ["gruzbik", "talumo", "abcd"], ["gruz-bik", "ab.cd", "zz", "talumotalumo", ""]

    def kernel(s, t):
        (x, a), (y, b) = coded([s]), coded([t])
        total = 0.0
        for p in PATTERNS:
            for q in PATTERNS:
                for i in range(max(0, a[0] - p[2])):
                    for j in range(max(0, b[0] - q[2])):
                        if all(x[0, i + m] == y[0, j + n] for m, n in zip((0, *p[:3]), (0, *q[:3]), strict=True)):
                            total += p[3] * q[3]
        return total / norms(a)[0] / norms(b)[0]

    want = np.array([[kernel(w, m) for m in marks] for w in words])
    assert np.allclose(landmark_features(words, marks), want)
    from clearpath.llm.toxicity import BITS, subsequences

    beta = np.array([1.0, -0.5, 2.0])
    row, code, w = subsequences(marks)
    folded = np.bincount(code, beta[row] * w, minlength=1 << BITS)
    assert np.allclose(item_values(words, folded, 0.25), want @ beta + 0.25)


def test_document_value_is_its_most_toxic_word():
    weights = np.zeros(1 << 20)
    assert document_values(["", "a b", "x y z w"], weights, -0.5).tolist() == [-0.5] * 3
