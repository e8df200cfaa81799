"""The audit of a whole project: copies read once, components followed, findings grouped.

1. Byte-identical files of one kind (extension, and whether they lie in a folder of layouts)
   are audited once; their findings are given to every copy.
2. With ``wrappers`` (name, element), definitions that drift from what they are declared as
   are findings too, and each call site inherits what its component's definition holds.
3. Every finding gets a ``group_key``, equal for findings of one rule on elements of one
   shape (tag, role, names of attributes), and a ``line_key`` that survives moves of its line.

Findings that no element begins at (of style sheets and scripts) have the empty shape. Files that
are null or repeated, and empty tables, give what ``audit`` gives for them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import group_id, group_key, shape
from ..operators.findings import collapse, identified
from ..operators.pages import LAYOUT_DIRS
from ..operators.registry import RULES, Rule, described
from ..operators.scope import spread, unique_sources
from ..operators.wrappers import drift, inherited
from .audit import audit, extension, tables

DRIFT = Rule("wrapper/drift", ("4.1.2",), "warning")


def shaped(found: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Findings with group_key and the text of their line."""
    place = ["file_id", "line", "col"]
    shapes = nodes.groupBy(*place).agg(F.min(shape(F.col("tag"), F.col("attr_names"), F.col("role"))).alias("_shape"))
    text = files.select("file_id", F.split(F.coalesce("source", F.lit("")), "\n").alias("_lines"))
    rows = found.join(shapes, place, "left").join(text, "file_id")
    return rows.withColumns({"group_key": group_key(F.col("rule_id"), F.coalesce("_shape", F.lit(""))), "_text": F.coalesce(F.get("_lines", F.col("line") - 1), F.lit(""))}).drop("_shape", "_lines")


def audit_project(files: DataFrame, wrappers: DataFrame | None = None, rule_ids: list[str] | None = None) -> DataFrame:
    """Findings of ``files`` (file_id, path, source) with their keys."""
    kinds = [extension(), F.coalesce(F.col("path").rlike(LAYOUT_DIRS), F.lit(False))]
    first, members = unique_sources(files, *kinds) if wrappers is None else (files, None)  # a component is known by its path
    t = tables(first)
    found = audit(first, rule_ids, t).drop("finding_id")
    if wrappers is not None:
        drifted = drift(t, wrappers).withColumn("severity", F.lit(DRIFT.severity))
        handed = inherited(t, found, wrappers).withColumn("message", F.concat("message", F.lit(" (in "), "name", F.lit(")")))
        found = found.unionByName(described(t, [drifted, handed], [*RULES.values(), DRIFT]))
    found = shaped(found, t.nodes, first)
    found = found if members is None else spread(found, members)
    return identified(found.withColumn("line_key", group_id(F.col("rule_id"), F.col("path"), F.col("_text"))).drop("_text"))


def groups(found: DataFrame) -> DataFrame:
    """One row a group key: rule, first place, occurrences and paths."""
    return collapse(found, ["rule_id", "group_key"]).select("rule_id", "group_key", "first.path", "first.line", "first.col", "occurrences", "paths")
