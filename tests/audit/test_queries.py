import pytest
from pyspark.sql import functions as F

from clearpath.plans.queries import ORACLE_SQL, QUERIES
from clearpath.operators.registry import run_rules
from clearpath.plans.audit import tables
from clearpath.plans.rule_cases import RULE_CASES
from clearpath.plans.switches import files, oracle

from ..oracle import run_sql, same

SF = "/root/testdata/sf0.001"
RULES_BY_SWITCH = {"rule_" + r.replace("/", "_").replace("-", "_") for r in RULE_CASES}
SOME_RULES = ["rule_navigation_link_descriptive_text", "rule_contrast_minimum", "rule_parsing_duplicate_id", "rule_semantics_heading_hierarchy", "rule_aria_hidden_focus"]


@pytest.mark.parametrize("name", [q for q in QUERIES if q in ORACLE_SQL and (not q.startswith(("rule_", "finder_")) or q in SOME_RULES) and q not in RULES_BY_SWITCH])
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLE_SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_rules_by_switch(spark):
    """All rules with switched markup in one plan: findings by file against each rule's SQL."""
    ids = sorted(RULE_CASES)
    parts = [files(spark, SF, RULE_CASES[r]).withColumns({"file_id": F.col("file_id") + i * 10**9, "path": F.concat(F.lit(f"{i}/"), "path")}) for i, r in enumerate(ids)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    got = {}
    with tables(every) as t:
        for r in run_rules(t, ids).groupBy("file_id", "rule_id").agg(F.count("*").alias("n")).collect():
            if r.rule_id == ids[r.file_id // 10**9]:
                got.setdefault(r.rule_id, set()).add((r.file_id % 10**9, r.n))
    wrong = {}
    for r in ids:
        names, rows = run_sql(oracle(RULE_CASES[r]), SF)
        want = {(row[names.index("file_id")], row[names.index("findings")]) for row in rows}
        if not want or got.get(r, set()) != want:
            wrong[r] = (len(want), sorted(got.get(r, set()) ^ want)[:4])
    assert not wrong


@pytest.mark.parametrize("rule_id", ["aria/labelledby-target-exists", "forms/label-for-id-mismatch", "forms/multiple-label-for-same-id", "navigation/in-page-link-fragment-missing", "navigation/skip-link"])
def test_rules_on_ids_run_alone(spark, rule_id):
    """The elements that an id names are there though no other rule of the run keeps them."""
    name = "rule_" + rule_id.replace("/", "_").replace("-", "_")
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_pages_are_dealt_by_number(spark, monkeypatch):
    """A table of pages is one row group, so its splits leave all parsing to one task."""
    from clearpath.plans import queries

    monkeypatch.setattr(queries, "PAGES_A_TASK", 10)
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    files = queries.page_files(spark, SF)
    assert files.rdd.getNumPartitions() == -(-pages.count() // 10) > 1
    assert files.select("file_id", "source").exceptAll(pages.select("page_id", "html")).count() == 0 and files.count() == pages.count()
