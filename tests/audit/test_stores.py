"""Stores: audits that remember, baselines, attestations; streams; pages of processes."""

from pyspark.sql import functions as F

from clearpath.operators.finders import run_finders
from clearpath.operators.processes import of_processes
from clearpath.operators.registry import Tables
from clearpath.plans import incremental
from clearpath.plans.audit import audit, tables
from clearpath.sources import stores
from clearpath.streaming.watch import watch_pages

SHAPE = "file_id long, path string, source string"
IDS = ["media/alt-text-missing", "parsing/duplicate-id"]


def seen(df):
    return sorted((r.file_id, r.path, r.rule_id, r.line, r.finding_id) for r in df.collect())


def test_second_audit_parses_nothing(spark, tmp_path, monkeypatch):
    folder = f"{tmp_path}/store"
    rows = [(1, "a.html", "<img>"), (2, "b.html", "<p id=x><p id=x>"), (3, "c.html", None), (4, "a.html", "<img>")]
    files = spark.createDataFrame(rows, SHAPE)
    want = seen(audit(files, IDS))
    assert len(want) == 3 and incremental.unknown(files, folder, IDS).count() == 3
    assert seen(incremental.audit_known(files, folder, IDS)) == want
    assert incremental.unknown(files, folder, IDS).count() == 0
    parsed = []
    monkeypatch.setattr(incremental, "tables", lambda f: parsed.append(f.count()) or tables(f))
    assert seen(incremental.audit_known(files, folder, IDS)) == want and parsed == []
    changed = spark.createDataFrame([*rows[:1], (2, "b.html", "<img><img>")], SHAPE)
    assert [x[2] for x in seen(incremental.audit_known(changed, folder, IDS))] == ["media/alt-text-missing"] * 3 and parsed == [1]
    assert incremental.unknown(files, folder, IDS[:1]).count() == 3  # another set of rules
    assert incremental.audit_known(spark.createDataFrame([], SHAPE), f"{tmp_path}/none", IDS).count() == 0


def test_baseline_store(spark, tmp_path):
    found = spark.createDataFrame([("h1", "r/a", "p", "m"), ("h1", "r/a", "p", "m"), ("h2", "r/b", "q", None)], "hash string, rule_id string, path string, message string")
    stores.write_baseline(found, ["wcag22"], f"{tmp_path}/base")
    got = sorted((r.version, r.standards, r.hash, r.path) for r in stores.read_baseline(spark, f"{tmp_path}/base").collect())
    assert got == [(1, ["wcag22"], "h1", "p"), (1, ["wcag22"], "h2", "q")]
    stores.write_baseline(found.limit(0), ["wcag22"], f"{tmp_path}/base")
    assert stores.read_baseline(spark, f"{tmp_path}/base").count() == 0


def test_attestation_store(spark, tmp_path):
    said = lambda c, at, verdict="pass", by="me": (c, ["r/a"], by, "looked", "manual", at, "site", verdict)
    rows = [said("wcag22:1.1.1", "2025-01-01T10:00:00Z"), said("wcag22:1.1.1", "2025-02-01T10:00:00Z", "fail"), said("gone:1", "2025-01-01T10:00:00Z"), said("wcag22:1.1.1", "soon"), said("wcag22:1.2.1", "2025-01-01T10:00:00Z", by=" ")]
    df = spark.createDataFrame(rows, stores.ATTESTATION)
    stores.append_attestations(df, f"{tmp_path}/a")
    stores.append_attestations(df.limit(1), f"{tmp_path}/a")
    store = stores.read_attestations(spark, f"{tmp_path}/a")
    assert store.count() == 4
    stores.prune_attestations(store, spark.createDataFrame([("wcag22:1.1.1",)], "criterion_id string"), f"{tmp_path}/b")
    assert [(r.criterion_id, r.verdict) for r in stores.read_attestations(spark, f"{tmp_path}/b").collect()] == [("wcag22:1.1.1", "fail")]


def test_stream_of_pages(spark, tmp_path):
    pages = "page_id long, url string, html string"
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    spark.createDataFrame([(1, "u", "<img>"), (2, "v", "<p>x</p>")], pages).write.parquet(f"{tmp_path}/in")
    run = lambda: watch_pages(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    run()
    spark.createDataFrame([(3, "w", "<img>")], pages).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = spark.read.parquet(f"{tmp_path}/out").filter(F.col("rule_id") == "media/alt-text-missing")
    assert sorted(r.file_id for r in got.collect()) == [1, 3]
    assert held() <= before


def test_processes_do_not_disturb_each_other(spark):
    page = "<nav><a href='/{}'>A</a><a href='/{}'>B</a></nav>"
    files = spark.createDataFrame([(1, "a.html", page.format("a", "b")), (2, "b.html", page.format("b", "a")), (3, "c.html", page.format("a", "b"))], SHAPE)
    steps = spark.createDataFrame([("one", 1, "a.html"), ("one", 2, "c.html"), ("two", 1, "a.html"), ("two", 2, "b.html")], "process string, ord int, path string")
    with tables(of_processes(files, steps)) as t:
        assert isinstance(t, Tables)
        asked = run_finders(t, ["review/consistent-navigation"]).join(t.files.select("file_id", "project"), "file_id")
        assert {r.project for r in asked.collect()} == {"two"}


def test_project_audit(spark):
    from clearpath.plans.project import audit_project, groups

    rows = [(1, "a/x.html", "<img src=a>\n<img src=b>"), (2, "b/x.html", "<img src=a>\n<img src=b>"), (3, "_layouts/x.html", "<img src=a>\n<img src=b>"), (4, "c.html", "\n <img src=a>"), (5, "d.html", None)]
    found = audit_project(spark.createDataFrame(rows, SHAPE), None, ["media/alt-text-missing"])
    got = found.collect()
    assert sorted((r.file_id, r.path, r.line) for r in got) == [(1, "a/x.html", 1), (1, "a/x.html", 2), (2, "b/x.html", 1), (2, "b/x.html", 2), (3, "_layouts/x.html", 1), (3, "_layouts/x.html", 2), (4, "c.html", 2)]
    assert len({r.group_key for r in got}) == 1 and len({r.finding_id for r in got}) == 7 and len({r.line_key for r in got}) == 7
    assert [(r.occurrences, r.paths, r.path) for r in groups(found).collect()] == [(7, 4, "_layouts/x.html")]
    parts = [(1, "Card.tsx", "const C = () => <div><img src='a' /></div>;"), (2, "p.tsx", "const P = () => <main><Card /><Card /></main>;")]
    wrappers = spark.createDataFrame([("Card", "section")], "name string, element string")
    told = audit_project(spark.createDataFrame(parts, SHAPE), wrappers, ["media/alt-text-missing"]).collect()
    assert sorted((r.file_id, r.rule_id) for r in told) == [(1, "media/alt-text-missing"), (1, "wrapper/drift"), (2, "media/alt-text-missing"), (2, "media/alt-text-missing")]
    assert {r.criteria[0] for r in told if r.rule_id == "wrapper/drift"} == {"4.1.2"}
