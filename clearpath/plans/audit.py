"""The audit: files in, findings out."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rules as _rules  # noqa: F401  registers the rules
from ..operators import rules_context as _more  # noqa: F401
from ..operators.findings import identified, merge_co_firing, suppress
from ..operators.registry import Tables, run_rules
from ..sources.css import read_css
from ..sources.dialects import MARKUP, SHEETS
from ..sources.html import DEPTH, read_elements


def pages_as_files(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("page_id").alias("file_id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").alias("source"))


def extension() -> F.Column:
    return F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))


def dialect(files: DataFrame, known: dict[str, str]) -> DataFrame:
    """The files whose extension is known, with their dialect."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return files.withColumn("dialect", table[extension()]).filter("dialect is not null")


def tables(files: DataFrame, depth: int | None = DEPTH) -> Tables:
    """Elements and declarations of all files (file_id, path, source); style elements are
    sheets of their file. Many rules read them, so both are persisted (on disk beyond
    memory): each file is parsed once, and what an executor loses is parsed again from its
    own files."""
    nodes = read_elements(dialect(files, MARKUP), depth).persist(StorageLevel.MEMORY_AND_DISK)
    # A style element's rules are numbered from its own node on, above those of any sheet.
    inner = nodes.filter("tag = 'style' and text <> ''").select("file_id", F.col("text").alias("source"), F.col("line").alias("first_line"), F.shiftleft(F.col("node_id").cast("long") + 1, 24).alias("first_rule"))
    sheets = read_css(dialect(files, SHEETS)).unionByName(read_css(inner))
    return Tables(files, nodes, sheets.persist(StorageLevel.MEMORY_AND_DISK))


def audit(files: DataFrame, rule_ids: list[str] | None = None, t: Tables | None = None) -> DataFrame:
    """All findings, comments heeded, pairs merged, with their ids: one plan. The caller who
    passes tables (``with tables(files) as t``) gives them back when done."""
    t = t or tables(files)
    return identified(merge_co_firing(suppress(run_rules(t, rule_ids), files)))
