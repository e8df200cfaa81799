"""Components that stand for native elements: their drift, and findings that call sites inherit.

``wrappers``: name, element. Names or files that are null match nothing; without
wrappers, both results are empty."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import Tables
from .scripts import of_project

#: Rules whose findings stay at the definition.
NOT_INHERITED = ["wrapper/drift", "internal/rule-crash"]


def component_name() -> F.Column:
    return F.regexp_extract("path", r"([A-Za-z_]\w*)\.(tsx|jsx|ts|js)$", 1)


def roots(t: Tables) -> DataFrame:
    """file_id, name, root tag, line and col of component files."""
    first = t.nodes.filter("parent_id is null").groupBy("file_id").agg(F.min(F.struct("node_id", "tag", "line", "col")).alias("r"))
    # Rows of many files look small where they are packed, or before they are made, and are not: neither side is for the driver.
    return t.files.select("file_id", component_name().alias("name")).filter("name <> ''").join(first.hint("merge"), "file_id").select("file_id", "name", "r.tag", "r.line", "r.col")


def drift(t: Tables, wrappers: DataFrame) -> DataFrame:
    """Definitions whose outermost element is not the declared one (rule wrapper/drift)."""
    rows = roots(t).join(wrappers.select("name", F.lower("element").alias("element")), "name").filter("tag <> element")
    return rows.select("file_id", "line", "col", F.concat(F.col("name"), F.lit(" is declared as "), "element", F.lit(" and is "), "tag").alias("message"), F.lit("wrapper/drift").alias("rule_id"))


def _told(t: Tables, findings: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Findings in wrappers' definitions, with the name that call sites say."""
    definitions = t.files.select("file_id", component_name().alias("name")).join(wrappers.select("name"), "name")
    told = findings.filter(~F.col("rule_id").isin(NOT_INHERITED)).select("file_id", "rule_id", "severity", "message").join(definitions, "file_id").withColumnRenamed("file_id", "defined_in")
    return told.withColumn("called", F.lower("name"))


def _calls(t: Tables) -> DataFrame:
    return t.nodes.filter("tag like 'x-%'").select("file_id", "line", "col", F.expr("substring(tag, 3)").alias("called"))


def inherited(t: Tables, findings: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Each finding in a wrapper's definition, once for every call site in other files:
    definitions, findings and call sites meet by name. As many rows as a name's findings
    times its call sites; ``inherited_counts`` counts them without making them."""
    return _told(t, findings, wrappers).join(_calls(t), "called").filter("file_id <> defined_in").select("file_id", "line", "col", "rule_id", "severity", "message", "name", "defined_in")


def inherited_counts(t: Tables, findings: DataFrame, wrappers: DataFrame) -> DataFrame:
    """file_id and findings: how many rows of ``inherited`` a file has. A file's call sites
    of a name times the name's findings, less those in the file itself: sums by name and by
    (name, file), so the work grows with findings and call sites and not with their product."""
    told = _told(t, findings, wrappers).groupBy("called", F.col("defined_in").alias("file_id")).agg(F.count("*").alias("_own"))
    every = told.groupBy("called").agg(F.sum("_own").alias("_every"))
    calls = _calls(t).groupBy("called", "file_id").agg(F.count("*").alias("_calls"))
    rows = calls.join(every, "called").join(told, ["called", "file_id"], "left")
    return rows.groupBy("file_id").agg(F.sum(F.col("_calls") * (F.col("_every") - F.coalesce("_own", F.lit(0)))).alias("findings")).filter("findings > 0")


def resolved_roots(t: Tables) -> DataFrame:
    """(project, name, tag): the native element that a component comes to, through as many
    components as there are between. Every round follows each component as far again as all
    rounds before, so their number is the logarithm of the longest way; a component that
    leads back to itself, or to one that is nowhere defined, has no row. Of several
    definitions of one name the first by file counts."""
    rows = of_project(t, roots(t)).withColumn("name", F.lower("name"))
    at = rows.groupBy("project", "name").agg(F.min(F.struct("file_id", "tag")).alias("r")).select("project", "name", "r.tag").persist()
    n = at.count()
    for _ in range(max(1, n).bit_length() + 1):
        onward = at.select("project", F.concat(F.lit("x-"), "name").alias("tag"), F.col("tag").alias("then"))
        new = at.join(met(onward, n), ["project", "tag"], "left").select("project", "name", F.coalesce("then", "tag").alias("tag"), (F.col("then") != F.col("tag")).alias("changed")).persist()
        moved = new.filter("changed").count()
        at.unpersist()
        at = new
        if not moved:
            break
    return at.filter("not tag like 'x-%'").drop("changed")


#: Rows that every task of a join may hold, and the driver on their way.
SMALL = 100_000


def met(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, of which there are ``n``, as a side of a join: for every task while they are
    few, else shuffled. What a persisted table takes when packed says little of its rows."""
    return F.broadcast(rows) if n <= SMALL else rows.hint("merge")


def with_components(t: Tables) -> Tables:
    """The tables with each use of a component as the native element it comes to, or that its
    ``as`` names, so all rules see it. With ``asChild`` the child stands for itself; the use
    stays a component."""
    known = resolved_roots(t).select("project", F.concat(F.lit("x-"), "name").alias("tag"), F.col("tag").alias("native"))
    given = F.lower(F.regexp_extract(F.coalesce(F.col("attrs")["as"], F.lit("")), r"^\s*([a-zA-Z][\w-]*)\s*$", 1))
    used = F.coalesce(F.col("tag").startswith("x-") & ~F.map_contains_key("attrs", F.lit("aschild")), F.lit(False))
    # Only uses meet the definitions: all other elements stay where they are.
    uses = of_project(t, t.nodes.filter(used)).join(met(known, known.count()), ["project", "tag"], "left")
    tag = F.when(given != "", given).otherwise(F.coalesce("native", "tag"))
    rows = t.nodes.filter(~used).unionByName(uses.withColumn("tag", tag).select(*t.nodes.columns))
    return Tables(t.files, rows, t.css, counts={"nodes": t.elements()})  # as many: a component comes to one element at most
