"""Odd rows and clashing columns in every stage of the pipeline."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHES = ("_gone_id", "_gone_key", "_text_key", "row", "text_key", "no_text", "_mix_key", "_mix_rank", "_mix_block", "node", "first", "component_id", "kept", "held_out", "trusted", "llr", "_rank", "_by", "_n")


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    text = base.filter("n_chars > 400 and lang is not null").orderBy("doc_id").first().text
    long = " ".join(f"{text} {i}" for i in range(400))
    odd = [(None, text + " one more ending", "en", "s", 1), (None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, long, "en", None, 2), (10**9 + 2, text, "en", "s", 1), (10**9 + 2, text, "en", "s", 1), (10**9 + 3, " \t\n", "xx", "s", 3)]
    more = spark.createDataFrame(odd, base.schema)
    return base.unionByName(more).withColumns({c: F.lit(f"user's {c}") for c in CLASHES}).repartition(5).persist()


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, SF)
    if name != "packing":
        assert out.columns == docs.columns
        kept = out.select(*CLASHES).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(f"user's {c}" for c in CLASHES)]
    assert out.count() > 0
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_without_an_id(spark):
    """A near copy goes whether it has an id or not, and one of a group stays."""
    words = [f"w{i}" for i in range(300)]
    text, more = " ".join(words), " ".join([*words, "again"])
    rows = [(1, text), (None, text), (None, more), (7, more), (None, "alone here"), (None, None), (8, "")]
    got = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, text), (None, "alone here"), (None, None), (8, "")], key=repr)
    none = spark.createDataFrame([(None, text), (None, more)], "doc_id long, text string")
    assert dict(corpus_pipeline.STAGES)["near_duplicates"](spark, none, SF).count() == 1
