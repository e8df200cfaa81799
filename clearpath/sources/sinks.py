"""Findings as text in the formats that other tools read. Every format is a column of
JSON, XML or Markdown fragments, written in parallel; only headers are constants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_json(findings: DataFrame) -> DataFrame:
    return findings.select(F.to_json(F.struct(*sorted(findings.columns))).alias("value"))


def as_sarif(findings: DataFrame) -> DataFrame:
    """One SARIF result a finding."""
    level = F.when(F.col("severity") == "info", "note").otherwise(F.col("severity"))
    region = F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn"))
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("value"))


def xml(c: str) -> F.Column:
    out = F.col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def as_junit(findings: DataFrame) -> DataFrame:
    """One test suite a file, with a failed case a finding."""
    case = F.concat(F.lit('<testcase name="'), xml("rule_id"), F.lit('"><failure message="'), xml("message"), F.lit('">line '), F.col("line").cast("string"), F.lit("</failure></testcase>"))
    suites = findings.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "col", case.alias("case")))), lambda x: x["case"]), "").alias("cases"), F.count("*").alias("n"))
    return suites.select(F.concat(F.lit('<testsuite name="'), xml("path"), F.lit('" failures="'), F.col("n").cast("string"), F.lit('">'), "cases", F.lit("</testsuite>")).alias("value"))


def as_markdown(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat(F.lit("| "), "severity", F.lit(" | "), "rule_id", F.lit(" | "), "path", F.lit(":"), F.col("line").cast("string"), F.lit(" | "), F.replace("message", F.lit("|"), F.lit("\\|")), F.lit(" |")).alias("value"))


def as_plain(findings: DataFrame) -> DataFrame:
    return findings.select(F.concat_ws(" ", F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string")), "severity", "rule_id", "message").alias("value"))


def as_html(findings: DataFrame) -> DataFrame:
    """One section a file, its findings in a list."""
    item = F.concat(F.lit('<li class="'), xml("severity"), F.lit('"><code>'), xml("rule_id"), F.lit("</code> line "), F.col("line").cast("string"), F.lit(": "), xml("message"), F.lit("</li>"))
    files = findings.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "col", item.alias("item")))), lambda x: x["item"]), "").alias("items"), F.count("*").alias("n"))
    return files.select(F.concat(F.lit("<section><h2>"), xml("path"), F.lit(" ("), F.col("n").cast("string"), F.lit(")</h2><ul>"), "items", F.lit("</ul></section>")).alias("value"))


def as_terminal(findings: DataFrame) -> DataFrame:
    """Plain lines with colours for terminals: red, yellow and blue."""
    colour = F.when(F.col("severity") == "error", "31").when(F.col("severity") == "warning", "33").otherwise("34")
    place = F.concat_ws(":", "path", F.col("line").cast("string"), F.col("col").cast("string"))
    return findings.select(F.concat(place, F.lit(" \x1b["), colour, F.lit("m"), "severity", F.lit("\x1b[0m "), "rule_id", F.lit(" "), "message").alias("value"))


def as_agent(findings: DataFrame) -> DataFrame:
    """One compact JSON object a file: its findings in order, for programs that read by file."""
    rows = findings.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "col", F.col("rule_id").alias("rule"), "severity", "message"))).alias("findings"))
    return rows.select(F.to_json(F.struct("findings", "path")).alias("value"))


FORMATS = {"json": as_json, "sarif": as_sarif, "junit": as_junit, "markdown": as_markdown, "plain": as_plain, "html": as_html, "terminal": as_terminal, "agent": as_agent}
