import corpus_pipeline
from clearpath.llm.language import language_id
from clearpath.llm.quality import quality_rules

from .test_neardup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_their_operators(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "quality_rules", "near_duplicates", "mixing", "packing"]
    verdict = {r.doc_id: r for r in language_id(docs).collect()}
    first = stages["language_id"](spark, docs, SF).persist()
    assert first.columns == docs.columns
    assert {r.doc_id: r.lang for r in first.collect()} == {d: v.lang_pred for d, v in verdict.items() if not v.rejected}
    kept = {r.doc_id for r in quality_rules(first, labels).collect() if r.kept}
    second = stages["quality_rules"](spark, first, SF).persist()
    assert {r.doc_id for r in second.collect()} == kept and second.columns == docs.columns
    third = stages["near_duplicates"](spark, second, SF).persist()
    rows = [(r.doc_id, r.text) for r in second.collect()]
    assert {r.doc_id for r in third.collect()} == {d for d, _, _, keep in brute(rows) if keep}
    fourth = stages["mixing"](spark, third, SF).persist()
    count = {}
    for r in fourth.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
    assert count.keys() == {r.doc_id for r in third.collect()} and max(count.values()) <= 2
    last = stages["packing"](spark, fourth, SF).collect()
    tokens = {}
    for r in last:
        tokens[r.doc_id] = tokens.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 2048
    whole = {r.doc_id: r.doc_tokens for r in last}
    assert tokens == {d: n * count[d] for d, n in whole.items()} and whole.keys() == count.keys()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
