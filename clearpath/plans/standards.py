"""Standards, criteria and what makes a rule active."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# criterion/level/first letter of how far it can be automated.
SHARED = (
    "1.1.1/A/p 1.2.1/A/m 1.2.2/A/p 1.2.3/A/m 1.2.4/AA/m 1.2.5/AA/m 1.2.6/AAA/m 1.2.7/AAA/m 1.2.8/AAA/m 1.2.9/AAA/m 1.3.1/A/p 1.3.2/A/m 1.3.3/A/m 1.3.4/AA/p 1.3.5/AA/f 1.3.6/AAA/m "
    "1.4.1/A/m 1.4.2/A/p 1.4.3/AA/p 1.4.4/AA/p 1.4.5/AA/m 1.4.6/AAA/p 1.4.7/AAA/m 1.4.8/AAA/m 1.4.9/AAA/m 1.4.10/AA/p 1.4.11/AA/p 1.4.12/AA/p 1.4.13/AA/p "
    "2.1.1/A/p 2.1.2/A/m 2.1.3/AAA/m 2.1.4/A/p 2.2.1/A/m 2.2.2/A/p 2.2.3/AAA/m 2.2.4/AAA/m 2.2.5/AAA/m 2.2.6/AAA/m 2.3.1/A/m 2.3.2/AAA/m 2.3.3/AAA/p "
    "2.4.1/A/f 2.4.2/A/f 2.4.3/A/p 2.4.4/A/p 2.4.5/AA/m 2.4.6/AA/p 2.4.7/AA/p 2.4.8/AAA/m 2.4.9/AAA/p 2.4.10/AAA/m 2.5.1/A/m 2.5.2/A/p 2.5.3/A/p 2.5.4/A/m 2.5.5/AAA/p 2.5.6/AAA/m "
    "3.1.1/A/f 3.1.2/AA/p 3.1.3/AAA/m 3.1.4/AAA/m 3.1.5/AAA/m 3.1.6/AAA/m 3.2.1/A/m 3.2.2/A/m 3.2.3/AA/m 3.2.4/AA/m 3.2.5/AAA/m 3.3.1/A/m 3.3.2/A/f 3.3.3/AA/m 3.3.4/AA/m 3.3.5/AAA/m 3.3.6/AAA/m "
    "4.1.1/A/m 4.1.2/A/p 4.1.3/AA/p"
)
ADDED_22 = "2.4.11/AA/p 2.4.12/AAA/m 2.4.13/AAA/m 2.5.7/AA/p 2.5.8/AA/p 3.2.6/A/m 3.3.7/A/m 3.3.8/AA/m 3.3.9/AAA/m"
ADDED_21 = "1.3.4 1.3.5 1.3.6 1.4.10 1.4.11 1.4.12 1.4.13 2.1.4 2.2.6 2.3.3 2.5.1 2.5.2 2.5.3 2.5.4 2.5.5 2.5.6 4.1.3"
PROFILES = {"wcag21-a": ("wcag21", "A"), "wcag21-aa": ("wcag21", "AA"), "wcag22-a": ("wcag22", "A"), "wcag22-aa": ("wcag22", "AA"), "wcag22-aaa": ("wcag22", "AAA"), "section508": ("section508", "base"), "en301549": ("en301549", "base")}
AUTOMATABLE = {"f": "full", "p": "partial", "m": "manual"}
RANK = {"A": 1, "AA": 2, "AAA": 3}


def criterion_rows() -> list[tuple]:
    """(id, standard, number, level, automatable, equivalent ids) of all standards."""
    shared = [x.split("/") for x in SHARED.split()]
    out = []
    for n, level, how in [x for x in shared if x[0] != "4.1.1"] + [x.split("/") for x in ADDED_22.split()]:
        out.append((f"wcag22:{n}", "wcag22", n, level, AUTOMATABLE[how], []))
    for n, level, how in shared:
        out.append((f"wcag21:{n}", "wcag21", n, level, AUTOMATABLE[how], [f"wcag22:{n}"]))
    new = set(ADDED_21.split())
    for n, level, how in shared:
        if level != "AAA":
            out.append((f"en301549:9.{n}", "en301549", f"9.{n}", "base", AUTOMATABLE[how], [f"wcag21:{n}"]))
            if n not in new:
                out.append((f"section508:{n}", "section508", n, "base", AUTOMATABLE[how], [f"wcag21:{n}"]))
    return out


_defined: list[tuple] = []


def define_standard(standard_id: str, rows: list[tuple[str, str, str, list[str]]]) -> None:
    """Add a standard: (number, level, automatable, equivalent criterion ids) of each criterion."""
    _defined.extend((f"{standard_id}:{n}", standard_id, n, level, how, same) for n, level, how, same in rows)


def criteria(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(criterion_rows() + _defined, "criterion_id string, standard_id string, local_id string, level string, automatable string, equivalent array<string>")


#: Pairs of a task; a round may make many more of them, and the next one deals those anew.
PAIRS_A_TASK = 50_000


def transitive(edges: DataFrame) -> DataFrame:
    """(a, reaches) for all nodes of ``edges`` (a, b), taken both ways, themselves included:
    joined on until no row is new, each round with paths twice as long. Pairs are dealt to
    tasks by their number, as a persisted table keeps the tasks it is made in."""
    distinct = lambda rows, n: rows.repartition(-(-n // PAIRS_A_TASK) or 1, "a", "b").distinct().persist()
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    walk = distinct(both.unionByName(both.select("a", F.col("a").alias("b"))), 4 * edges.count())
    n = walk.count()
    while True:
        longer = distinct(walk.join(walk.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), n)
        m = longer.count()
        walk.unpersist()
        walk = longer
        if m == n:
            return walk.withColumnRenamed("b", "reaches")
        n = m


def closure(spark: SparkSession) -> DataFrame:
    """(criterion_id, reaches): all criteria connected by equivalence, itself included."""
    rows = criteria(spark)
    known = rows.select(F.col("criterion_id").alias("b"))
    edges = rows.select(F.col("criterion_id").alias("a"), F.explode("equivalent").alias("b")).join(known, "b", "left_semi").select("a", "b")
    reached = transitive(edges)
    alone = rows.select(F.col("criterion_id").alias("a")).join(reached.select("a").distinct(), "a", "left_anti")
    return reached.unionByName(alone.select("a", F.col("a").alias("reaches"))).withColumnRenamed("a", "criterion_id")


def cited(spark: SparkSession, findings: DataFrame, standards: list[str], level: str) -> DataFrame:
    """Findings of rules that an enabled standard asks for at ``level``, with all the
    criteria of enabled standards that they touch. Rules name numbers of either edition.
    Findings are read once: criteria are a table of one row (at most an entry a criterion)
    that they look into, and findings alike but for their criteria share a window."""
    rows = criteria(spark).filter(F.col("standard_id").isin(standards))
    ranks = F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))
    touched = closure(spark).join(rows.select(F.col("criterion_id").alias("reaches"), "level"), "reaches")
    by_number = touched.filter("criterion_id like 'wcag%'").select(F.split("criterion_id", ":")[1].alias("number"), "reaches", (F.coalesce(ranks[F.col("level")], F.lit(0)) <= RANK.get(level, 3)).alias("asked"))
    known = by_number.groupBy("number").agg(F.collect_set("reaches").alias("ids"), F.bool_or("asked").alias("asked"))
    entry = F.struct("number", F.struct("ids", "asked"))
    table = F.broadcast(known.agg(F.map_from_entries(F.collect_list(entry)).alias("_known")))
    met = F.array_compact(F.transform("criteria", lambda n: F.col("_known")[n]))
    spread = findings.crossJoin(table).withColumn("_met", met).drop("_known")
    alike = Window.partitionBy("path", "line", "col", "rule_id", "message")
    spread = spread.select(*findings.columns, F.collect_set(F.flatten(F.col("_met.ids"))).over(alike).alias("cited"), F.max(F.exists("_met", lambda x: x["asked"])).over(alike).alias("_asked"))
    return spread.filter("_asked").withColumn("cited", F.array_sort(F.array_distinct(F.flatten("cited")))).drop("_asked")
