import math

from clearpath.llm import mixing
from clearpath.llm.mixing import ORACLE, mixed_documents, mixture, op1_mixing

from .oracle import same


def test_against_sql(spark):
    same(op1_mixing(spark, "/root/testdata/sf0.001"), ORACLE, "/root/testdata/sf0.001")


def corpus(spark):
    rows = [(i, "w " * (5 + i % 7), "big", 9, 9) for i in range(300)] + [(1000 + i, "x y z", "small", 1, 1) for i in range(10)]
    rows += [(None, None, None, 1, 1), (5, "", None, 1, 1), (5, "", None, 1, 1), (6, "a b", "mid", 2, 2)] + [(i, "m n o p q", "mid", 2, 2) for i in range(2000, 2040)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, position int, epoch int").repartition(5)


def test_many_rows_of_one_id(spark, tmp_path, monkeypatch):
    """Rows without an id, and of one id, are cut into many buckets; the stream is the same."""
    rows = [(None, "w " * (i % 3), "a") for i in range(600)] + [(7, "x y", "a") for _ in range(300)] + [(i, "x " * (i % 9), "ab"[i % 2]) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    same(op1_mixing(spark, str(tmp_path)), ORACLE, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(str, mixed_documents(docs, max_repetition=1.0).collect())) == sorted(map(str, docs.collect()))


def test_weights_and_repetition(spark):
    df = corpus(spark)
    got = mixture(df, max_repetition=3.0, entropy_share=1.0, block_tokens=200).collect()
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    have = {None: 3, "big": sum(6 + i % 7 for i in range(300)), "small": 40, "mid": 243}
    t = 1 - math.log(3) / math.log(have["big"] / 3)  # the repetition limit binds
    for s, n in have.items():
        assert abs(used[s] - n * (have["big"] / n) ** (1 - t)) <= 12
    assert {r.doc_id for r in got if r.source == "big"} == set(range(300))
    blocks = {}
    for r in got:
        blocks.setdefault(r.block, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in blocks.values()) and len(blocks) > 10
    share = [sum(r.n_tokens for r in got if r.block == b and r.source == "big") for b in range(len(blocks))]
    assert max(share) - min(share) <= 30  # each block holds the same mixture


def test_fixed_budget_and_entropy(spark):
    df = corpus(spark)
    got = mixture(df, budget=1000, entropy_share=0.8, max_repetition=1e9, block_tokens=500).collect()
    used = {}
    for r in got:
        used[r.source] = used.get(r.source, 0) + r.n_tokens
    total = sum(used.values())
    entropy = -sum(v / total * math.log(v / total) for v in used.values())
    assert abs(total - 1000) < 40 and abs(entropy - 0.8 * math.log(4)) < 0.03


def test_documents_keep_columns(spark):
    df = corpus(spark)
    out = mixed_documents(df, max_repetition=1.0)
    assert out.columns == df.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, df.collect()))
    assert mixed_documents(df.limit(0)).count() == 0 and mixture(df.limit(0)).count() == 0
