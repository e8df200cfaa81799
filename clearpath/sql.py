"""The library for users of SQL: table functions over a column, and views over a table.

    clearpath.sql.register(spark)
    SELECT p.page_id, e.tag, e.line FROM pages p, LATERAL markup_elements(p.html) e
    SELECT p.page_id, x.line, x.token FROM pages p, LATERAL switched_off(p.html) x

    clearpath.sql.views(spark, "my_files")   -- file_id, path, source
    SELECT rule_id, count(*) FROM findings GROUP BY rule_id

A table function reads one value at a time where its row is, without a shuffle; views are
the plans of the library, so a query on ``findings`` is the audit. Null values give no row.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from .operators.findings import pragma_lines
from .plans.audit import audit, tables
from .sources.css import declarations
from .sources.dialects import MARKUP, SHEETS, markup, sheet
from .sources.html import elements
from .sources.scripts import tokens


@udtf(returnType="node_id int, parent_id int, tag string, attrs map<string,string>, text string, line int, col int")
class MarkupElements:
    """Elements of a source; an optional second argument is its file extension."""

    def eval(self, source: str, extension: str = "html"):
        for n in elements(markup(source, MARKUP.get(extension, ""))) if source is not None else ():
            yield n["node_id"], n["parent_id"], n["tag"], n["attrs"], n["text"], n["line"], n["col"]


@udtf(returnType="selector string, property string, value string, important boolean, line int")
class StyleDeclarations:
    def eval(self, source: str, extension: str = "css"):
        for _, selector, _, line, name, value, important, _ in declarations(sheet(source, SHEETS.get(extension, ""))) if source is not None else ():
            yield selector, name, value, important, line


@udtf(returnType="kind string, text string, start int")
class ScriptTokens:
    def eval(self, source: str):
        for start, _, kind, text in tokens(source) if source is not None else ():
            yield kind, text, start


@udtf(returnType="line int, token string")
class SwitchedOff:
    """Lines that comments switch rules off for; the token is a rule or *."""

    def eval(self, source: str):
        yield from pragma_lines(source) if source is not None else ()


FUNCTIONS = {"markup_elements": MarkupElements, "style_declarations": StyleDeclarations, "source_tokens": ScriptTokens, "switched_off": SwitchedOff}


def register(spark: SparkSession) -> None:
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)


def views(spark: SparkSession, files: str, rules: list[str] | None = None) -> None:
    """Temporary views ``elements``, ``declarations`` and ``findings`` over a table of files."""
    source = spark.table(files)
    t = tables(source)
    t.nodes.createOrReplaceTempView("elements")
    t.css.createOrReplaceTempView("declarations")
    audit(source, rules, t).createOrReplaceTempView("findings")
