"""Which findings, files and criteria count: filters, predicates, order and pages.

All take and return DataFrames (or a column), read only the columns they name, and pass
others through. Null severities, paths and criteria match nothing. Empty tables give
empty results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------
SEVERITIES = {"error": 1, "warning": 2, "info": 3}
MEDIA_CRITERIA = ["1.2.1", "1.2.2", "1.2.3", "1.2.4", "1.2.5", "1.2.6", "1.2.7", "1.2.8", "1.2.9", "1.4.2", "1.4.7"]
VENDOR_SCRIPTS = r"(?i)(^|/)(jquery|bootstrap|popper|lodash|moment|d3|chart|angular|vue|react|swiper|slick)([.-][\w.-]*)?\.js$"
VENDOR_SHEETS = r"(?i)\.(css|scss|less)$"


def rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITIES.items() for x in kv)), severity)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    """Findings of this severity or a graver one."""
    return findings.filter(rank(F.col("severity")) <= SEVERITIES[severity])


def fails(findings: DataFrame, severity: str) -> DataFrame:
    """One row: whether any finding is as grave as ``severity``."""
    return findings.agg(F.coalesce(F.bool_or(rank(F.col("severity")) <= SEVERITIES[severity]), F.lit(False)).alias("fails"))


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression: ** crosses folders, * and ? do not, {a,b} and [x] choose."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            out, i = out + "[" + re.sub(r"^!", "^", glob[i + 1 : end]) + "]", end + 1
            continue
        depth += (c == "{") - (c == "}" and depth > 0)
        out += {"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|" if depth else ","}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path matches the globs: later ones win, those that begin with ! exclude."""
    out = F.lit(False)
    for g in globs:
        out = F.when(path.rlike(glob_pattern(g.removeprefix("!"))), F.lit(not g.startswith("!"))).otherwise(out)
    return out


def without_wrapper_noise(findings: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Findings whose ``element`` is no declared wrapper (wrappers: name)."""
    return findings.join(wrappers.select(F.col("name").alias("element")).distinct(), "element", "left_anti")


def skip_criteria(findings: DataFrame, skipped: list[str]) -> DataFrame:
    """Skipped criteria leave the findings; a finding left without any goes."""
    rest = F.array_except("criteria", F.array(*map(F.lit, skipped)).cast("array<string>"))
    return findings.withColumn("criteria", rest).filter(F.size("criteria") > 0)


def applicable(criteria: DataFrame, nodes: DataFrame) -> DataFrame:
    """Criteria on media do not apply where no file has audio or video (criteria: local_id)."""
    media = nodes.filter("tag in ('audio', 'video', 'track', 'object', 'embed')").limit(1).select(F.lit(True).alias("_media"))
    return criteria.join(media, how="left").withColumn("applicable", ~F.col("local_id").isin(MEDIA_CRITERIA) | F.coalesce("_media", F.lit(False))).drop("_media")


def couple_severity(findings: DataFrame, tokens: list[str]) -> DataFrame:
    """Findings whose codes ask for a look at the source are for information."""
    asks = F.arrays_overlap(F.coalesce("codes", F.array().cast("array<string>")), F.array(*map(F.lit, tokens)).cast("array<string>"))
    return findings.withColumn("severity", F.when(asks, "info").otherwise(F.col("severity")))


def changed_files(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose path a commit or the index changed (changed: path)."""
    return files.join(changed.select("path").distinct(), "path", "left_semi")


def in_order(findings: DataFrame) -> DataFrame:
    """By path, line, column and rule, as reports list them."""
    return findings.orderBy("path", "line", "col", "rule_id")


def page(findings: DataFrame, offset: int, limit: int) -> DataFrame:
    return in_order(findings).offset(offset).limit(limit)


def within_budget(findings: DataFrame, characters: int) -> DataFrame:
    """Files in order of path while the sum of their rendered findings stays within the
    budget; the first file always. ``rendered``: the text of a finding."""
    size = findings.groupBy("path").agg(F.sum(F.length("rendered")).alias("_size"))
    # Sums over files by the first letters of their paths, then within: one short window and one by prefix.
    size = size.withColumn("_key", F.substring("path", 1, 8))
    before = size.groupBy("_key").agg(F.sum("_size").alias("_sum"))
    before = before.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_key", "_before")
    total = F.col("_before") + F.sum("_size").over(Window.partitionBy("_key").orderBy("path").rowsBetween(Window.unboundedPreceding, 0))
    kept = size.join(before, "_key").withColumn("_total", total).filter((F.col("_total") <= characters) | (F.col("_total") == F.col("_size")))
    return findings.join(kept.select("path"), "path", "left_semi")


def vendor_dedupe(findings: DataFrame) -> DataFrame:
    """Findings of copied vendor files (style sheets, known libraries) that agree in file
    name, rule and pattern (or message): the first by path and line, with the number of
    occurrences and the other paths. Other findings: one occurrence each. A group is
    folded by partial aggregation; nothing is ranked within one key."""
    vendor = F.col("path").rlike(VENDOR_SHEETS) | F.col("path").rlike(VENDOR_SCRIPTS)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    pattern = F.col("pattern_id") if "pattern_id" in findings.columns else F.lit(None).cast("string")
    rows = findings.withColumns({"_vendor": vendor, "_name": name, "_what": F.coalesce(pattern, F.col("message"))})
    first = F.min(F.struct("path", "line", "col", "message", "severity"))
    folded = rows.filter("_vendor").groupBy("rule_id", "_name", "_what").agg(first.alias("first"), F.count("*").alias("occurrences"), F.array_sort(F.collect_set("path")).alias("paths"))
    several = folded.filter(F.size("paths") >= 2)
    out = several.select("rule_id", "first.*", "occurrences", F.slice("paths", 2, F.greatest(F.size("paths") - 1, F.lit(1))).alias("also_in"))
    single = folded.filter(F.size("paths") < 2).select("rule_id", "_name", "_what")
    none = F.array().cast("array<string>").alias("also_in")
    shape = ["rule_id", "path", "line", "col", "message", "severity"]
    alone = rows.filter("_vendor").join(single, ["rule_id", "_name", "_what"], "left_semi").select(*shape, F.lit(1).cast("long").alias("occurrences"), none)
    return out.select(*shape, "occurrences", "also_in").unionByName(alone).unionByName(rows.filter("not _vendor").select(*shape, F.lit(1).cast("long").alias("occurrences"), none))


def rules_by_criterion(rules: DataFrame) -> DataFrame:
    """criterion and the rules that serve it (rules: rule_id, criteria)."""
    return rules.select("rule_id", F.explode("criteria").alias("criterion")).groupBy("criterion").agg(F.array_sort(F.collect_set("rule_id")).alias("rules"))


def unique_sources(files: DataFrame, *same: Column) -> tuple[DataFrame, DataFrame]:
    """Byte-identical files (that are alike in ``same`` too): the representatives (smallest
    id), and (file_id, path, first) of every file with its representative's id."""
    kind = F.concat_ws("|", *(F.coalesce(c.cast("string"), F.lit("")) for c in same), F.lit(""))
    keyed = files.withColumn("_print", F.sha2(F.concat(kind, F.coalesce("source", F.lit(""))), 256))
    first = keyed.groupBy("_print").agg(F.min("file_id").alias("first"))
    members = keyed.select("file_id", "path", "_print").join(first, "_print").select("file_id", "path", "first")
    return files.join(first.select(F.col("first").alias("file_id")), "file_id", "left_semi"), members


def spread(findings: DataFrame, members: DataFrame) -> DataFrame:
    """Findings of representatives, given to all their copies."""
    columns = findings.columns
    return findings.withColumnRenamed("file_id", "first").drop("path").join(members, "first").select(*columns)
