"""The corpus pipeline: five stages over ``documents``, each written before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clearpath.llm.common import materialize, table
from clearpath.llm.language import filter_language
from clearpath.llm.mixing import mixed_documents
from clearpath.llm.neardup import drop_near_duplicates
from clearpath.llm.packing import pack
from clearpath.llm.quality import filter_quality
from clearpath.llm.tokens import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a recognised language go on, with the language found. From here on
    texts go to Python workers a thousand or 4 MB at a time: the same workers run all stages,
    and later ones hold a vocabulary besides."""
    for name, value in BATCH.items():
        spark.conf.set(name, value)
    return filter_language(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and the log-likelihood ratio go on."""
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates goes on, by shingles of three words
    and 85 %, then by shingles of five words and 80 %."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed stream: every document at least once, small sources at most twice."""
    return mixed_documents(docs, max_repetition=MAX_REPETITION)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens with their ids, in the order of the stream's chunks."""
    return pack(docs, vocabulary("word_bpe_49k.json"), with_ids=True, remember=60_000)


#: Rows and bytes that go to a Python worker at a time.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}
#: How often the mixing stage repeats a document at most.
MAX_REPETITION = 2.0

STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("packing", packing),
]

#: The language and quality stages are trained models and packing needs a tokenizer:
#: not in SQL. tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again, so what a
    stage rests on is on disk before the next begins. The session's settings of a batch
    are as before at the end."""
    docs, before = table(spark, sf_dir, "documents"), {name: spark.conf.get(name) for name in BATCH}
    try:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return docs
