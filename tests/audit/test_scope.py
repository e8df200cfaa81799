import pytest
from pyspark.sql import functions as F

from clearpath.plans.scope_queries import ORACLE_SQL, QUERIES

from ..oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLE_SQL[name], SF)


def test_inherited_counts_are_the_rows_of_inherited(spark):
    """Two thousand findings of one name and two thousand call sites: sums, not four million rows."""
    from clearpath.operators.wrappers import inherited, inherited_counts
    from clearpath.plans.audit import tables

    some = [(1, "a/Card.tsx", "const C = () => <div><img src='a' /><Card /></div>;"), (2, "b/Card.tsx", "const C = () => <div><img src='b' /></div>;"), (3, "p.tsx", "const P = () => <main><Card /><Card /><Other /></main>;"), (4, "Other.tsx", "const O = () => <div><img src='c' /></div>;")]
    wrappers = spark.createDataFrame([("Card", "div")], "name string, element string")
    schema = "file_id long, path string, source string"
    t = tables(spark.createDataFrame(some, schema))
    found = t.nodes.filter("tag = 'img'").select("file_id", F.lit("media/alt-text-missing").alias("rule_id"), F.lit("error").alias("severity"), F.lit("m").alias("message"))
    got = {r.file_id: r.findings for r in inherited_counts(t, found, wrappers).collect()}
    assert got == {r.file_id: r["count"] for r in inherited(t, found, wrappers).groupBy("file_id").count().collect()} == {1: 1, 3: 4}
    t.__exit__()
    rows = spark.range(4000).selectExpr("id as file_id", "if(id < 2000, concat('d', id, '/Card.tsx'), concat('p', id, '.tsx')) as path", "if(id < 2000, '<img />', '<Card />') as source")
    t = tables(rows)
    found = t.nodes.filter("tag = 'img'").select("file_id", F.lit("r").alias("rule_id"), F.lit("error").alias("severity"), F.lit("m").alias("message"))
    out = inherited_counts(t, found, wrappers).agg(F.count("*").alias("n"), F.sum("findings").alias("sum")).first()
    assert tuple(out) == (2000, 4_000_000)
    t.__exit__()


def test_rows_of_part_are_dealt_by_number(spark):
    """Markup is many times its row: a small file is not left to one task."""
    from clearpath.plans.switches import ROWS_A_TASK, parts

    rows = parts(spark, "/root/testdata/sf0.1")
    assert rows.rdd.getNumPartitions() == -(-rows.count() // ROWS_A_TASK) > 1


def test_components_of_many_files_do_not_pass_the_driver(spark, monkeypatch):
    """No join sends a table that grows with the files to the driver, whatever it looks like when packed."""
    from clearpath.operators import wrappers
    from clearpath.plans.audit import tables

    monkeypatch.setattr(wrappers, "SMALL", 0, raising=False)
    sources = [("Base.tsx", "const B = () => <button>x</button>;"), ("Button.tsx", "const B = () => <Base>y</Base>;"), ("Loop.tsx", "const L = () => <Loop />;"), ("4.tsx", "const P = () => <main><Button></Button><Button asChild></Button><Button as='a'></Button><Loop /><Nowhere /></main>;")]
    rows = [(10 * p + i, f"src/{p}/{name}", text if p else text.replace("button", "div"), str(p)) for p in (0, 1) for i, (name, text) in enumerate(sources)]
    t = tables(spark.createDataFrame(rows, "file_id long, path string, source string, project string"))
    made = wrappers.with_components(t)
    assert "Broadcast" not in made.nodes._jdf.queryExecution().executedPlan().toString()
    for p, native in ((0, "div"), (1, "button")):
        got = [r.tag for r in made.nodes.filter(f"file_id = {10 * p + 3}").orderBy("node_id").collect()]
        assert got == ["main", native, "x-button", "a", "x-loop", "x-nowhere"]
    assert made.elements() == made.nodes.count() == t.nodes.count()
