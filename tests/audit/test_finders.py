import pytest
from pyspark.sql import functions as F

from clearpath.operators.finders import FINDERS, prune, run_finders
from clearpath.plans.audit import tables
from clearpath.plans.switches import FINDER_CASES, files, oracle

from ..oracle import run_sql

SF = "/root/testdata/sf0.001"


def test_every_finder_has_a_case():
    assert set(FINDER_CASES) == set(FINDERS)


@pytest.mark.parametrize("name", sorted(FINDER_CASES))
def test_against_sql(spark, name):
    case = FINDER_CASES[name]
    got = run_finders(tables(files(spark, SF, case)), [name]).groupBy("file_id").agg(F.count("*").alias("findings"))
    names, want = run_sql(oracle(case), SF)
    assert sorted((r.file_id, r.findings) for r in got.collect()) == sorted(tuple(r[names.index(n)] for n in ("file_id", "findings")) for r in want)
    assert want


def test_no_files(spark):
    t = tables(spark.createDataFrame([(1, "a.html", None), (2, "b.css", None), (3, "c.js", None)], "file_id long, path string, source string"))
    assert run_finders(t).count() == 0


def test_prune(spark):
    c = spark.createDataFrame([(1, 2, "1.3.6"), (1, 3, "1.3.6"), (1, 2, "2.4.6")], "file_id long, line int, criterion string")
    f = spark.createDataFrame([(1, 2, ["1.3.5", "4.1.2"])], "file_id long, line int, criteria array<string>")
    assert sorted(tuple(r) for r in prune(c, f).select("line", "criterion").collect()) == [(2, "2.4.6"), (3, "1.3.6")]
