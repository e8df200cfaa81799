"""Plans stay small, as the driver's memory follows them: Spark plans all of what is left
anew after each shuffle of a query."""

from clearpath.llm import components, neardup
from clearpath.llm.mixing import exponent

SF = "/root/testdata/sf0.001"


def test_no_written_plan_has_many_joins(spark, monkeypatch):
    joins, write = {}, neardup.materialize

    def counted(df, label, **options):
        joins[label] = max(joins.get(label, 0), df._jdf.queryExecution().optimizedPlan().toString().count("Join "))
        return write(df, label, **options)

    monkeypatch.setattr(neardup, "materialize", counted)
    monkeypatch.setattr(components, "materialize", counted)
    neardup.drop_near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert {"edges", "stars", "clusters"} <= joins.keys()
    assert max(joins.values()) <= 7, joins


def test_passes_of_the_bisection_are_small(spark, monkeypatch):
    rows = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "_mix_source string, _mix_t long")
    plans, collect = [], type(rows).collect

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return collect(df)

    monkeypatch.setattr(type(rows), "collect", seen)
    t = exponent(rows, 1000, 900, 10, 3, None, entropy_share=1.0, max_repetition=5.0)
    assert abs(90 ** (1 - t) - 5.0) < 1e-4
    assert len(plans) > 3 and max(p.count("sum(") for p in plans) <= 4
