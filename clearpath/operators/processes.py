"""Ordered page processes: pages that are compared with each other, and no others.

A process is a sequence of pages (``process``, ``ord``, ``path``), as the steps of an order.
``of_processes`` gives each step a file of its own whose project is its process, so all that
compares pages of a project (names, navigation, scripts) compares along one process.
``changed_along`` looks at neighbours: the step where an element that is on both pages has
another name than on the step before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import phrase
from .registry import Tables
from .rules import attr, interactive


def of_processes(files: DataFrame, steps: DataFrame) -> DataFrame:
    """file_id (of the step), page_id (the file's own), project, ord, path and source."""
    own = files.select(F.col("file_id").alias("page_id"), "path", "source")
    rows = own.join(steps.select(F.col("process").cast("string").alias("project"), "ord", "path"), "path")
    return rows.select(F.xxhash64("page_id", "project", "ord").alias("file_id"), "page_id", "project", "ord", "path", "source")


def changed_along(t: Tables) -> DataFrame:
    """file_id, line, col, ord, key, before and now of controls (by test id or label) whose
    text is not that of the step before on which they stood. One window by process and key."""
    key = F.coalesce(F.nullif(attr("data-testid"), F.lit("")), F.nullif(attr("aria-label"), F.lit("")))
    rows = t.nodes.filter(interactive()).select("file_id", "line", "col", "node_id", key.alias("key"), phrase(F.col("text")).alias("now")).filter("key is not null and now <> ''")
    rows = rows.join(t.files.select("file_id", "project", "ord"), "file_id")
    first = rows.groupBy("project", "ord", "key").agg(F.min(F.struct("node_id", "file_id", "line", "col", "now")).alias("x"))
    before = F.lag("x.now").over(Window.partitionBy("project", "key").orderBy("ord"))
    return first.withColumn("before", before).select("x.file_id", "x.line", "x.col", "project", "ord", "key", "before", "x.now").filter("before <> now")
