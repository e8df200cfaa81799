"""What happens to findings: suppression, merging, collapsing, comparing, counting."""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import finding_id
from ..sources.dialects import SHEETS
from ..sources.lines import line_finder
from ..sources.scripts import SCRIPTS, tokens

# Of findings at one place, the first rule takes in the second.
CO_FIRE = [("forms/placeholder-as-label", "forms/value-as-label"), ("navigation/href-empty-fragment", "navigation/link-descriptive-text")]
SEVERITY = {"error": 1, "warning": 2, "info": 3}

_PRAGMA = re.compile(r"a11y-(disable-next-line|disable-line|disable|enable)\b([^\n]*?)(?:-->|\*/|#\}|%>|\}\}|$)", re.M)


#: What a comment is, in scripts, style sheets and markup (with templates and scripts in it).
_IN_SHEETS = re.compile(r"/\*.*?(?:\*/|\Z)|(?<![:\w])//[^\n]*", re.S)
_IN_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|/\*.*?(?:\*/|\Z)|\{#.*?#\}|<%#.*?%>|\{\{!.*?\}\}|^[ \t]*//[^\n]*", re.S | re.M)


def marks(source: str, ext: str = "html") -> list[re.Match]:
    """The marks that stand in comments; in strings and prose they are text."""
    if ext in SCRIPTS:
        spans = [(a, z) for a, z, kind, _ in tokens(source) if kind == "comment"]
        # Comments between elements of JSX are not told from text by tokens alone.
        spans += [m.span() for m in re.finditer(r"\{/\*.*?\*/\}", source, re.S)] if ext in ("jsx", "tsx") else []
    else:
        spans = [m.span() for m in (_IN_SHEETS if ext in SHEETS else _IN_MARKUP).finditer(source)]
    spans.sort()
    starts = [a for a, _ in spans]
    inside = lambda at: (i := bisect.bisect_right(starts, at) - 1) >= 0 and at < max(z for _, z in spans[max(0, i - 1) : i + 1])
    return [m for m in _PRAGMA.finditer(source) if inside(m.start())]


def pragma_lines(source: str, ext: str = "html") -> list[tuple[int, str]]:
    """(line, rule or *) that comments switch off. A region begins on the line after its
    mark; the end mark ends the latest region, and its own line is still off."""
    out, open_ = [], []
    total, line_of = source.count("\n") + 1, line_finder(source)
    for m in marks(source, ext):
        line = line_of(m.start())
        rules = re.split(r"--|:(?!\d)", m[2])[0].replace(",", " ").split() or ["*"]
        if m[1] == "disable-line":
            out += [(line, r) for r in rules]
        elif m[1] == "disable-next-line":
            out += [(line + 1, r) for r in rules]
        elif m[1] == "disable":
            open_.append((line + 1, rules))
        elif open_:
            start, rules = open_.pop()
            out += [(n, r) for n in range(start, line + 1) for r in rules]
    for start, rules in open_:
        out += [(n, r) for n in range(start, total + 1) for r in rules]
    return out


def _extension(files: DataFrame) -> Column:
    return (F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)) if "path" in files.columns else F.lit("html")).alias("ext")


def pragma_reasons(files: DataFrame) -> DataFrame:
    """file_id, line and reason (null: none given) of every comment that switches something off."""
    schema = pa.schema([("file_id", pa.int64()), ("line", pa.int32()), ("reason", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for file_id, source, ext in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                line_of = line_finder(source)
                for m in marks(source, ext):
                    if m[1] != "enable":
                        said = re.split(r"--|:(?!\d)", m[2], maxsplit=1)
                        rows.append({"file_id": file_id, "line": line_of(m.start()), "reason": said[1].strip() or None if len(said) > 1 else None})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.filter(F.contains("source", F.lit("a11y-"))).select("file_id", "source", _extension(files)).mapInArrow(run, "file_id long, line int, reason string")


def pragmas(files: DataFrame) -> DataFrame:
    """file_id, line and token of what comments switch off."""
    schema = pa.schema([("file_id", pa.int64()), ("line", pa.int32()), ("token", pa.string())])

    def run(batches):
        for batch in batches:
            rows = [(f, *x) for f, s, e in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in pragma_lines(s or "", e)]
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    return files.filter(F.contains("source", F.lit("a11y-"))).select("file_id", "source", _extension(files)).mapInArrow(run, "file_id long, line int, token string")


def suppress(findings: DataFrame, files: DataFrame) -> DataFrame:
    """Findings that no comment switches off: one join by line."""
    off = pragmas(files).groupBy(F.col("file_id").alias("_file"), F.col("line").alias("_line")).agg(F.collect_set("token").alias("_off"))
    rows = findings.join(off, (F.col("file_id") == F.col("_file")) & (F.col("line") == F.col("_line")), "left")
    return rows.filter(F.col("_off").isNull() | ~(F.array_contains("_off", "*") | F.array_contains("_off", F.col("rule_id")))).select(*findings.columns)


def merge_co_firing(findings: DataFrame, pairs: list[tuple[str, str]] = CO_FIRE) -> DataFrame:
    """Of two findings of a pair at one place the first stays, with both rules' criteria. One
    window by place."""
    place = Window.partitionBy("file_id", "line", "col")
    here = F.collect_set(F.when(F.col("rule_id").isin(*{r for p in pairs for r in p}), F.struct("rule_id", "criteria"))).over(place)
    rows = findings.withColumn("_here", here)
    fires = lambda r: F.exists("_here", lambda x: x["rule_id"] == r)
    criteria_of = lambda r: F.flatten(F.transform(F.filter("_here", lambda x: x["rule_id"] == r), lambda x: x["criteria"]))
    gone, more = F.lit(False), F.array().cast("array<string>")
    for first, second in pairs:
        gone = gone | ((F.col("rule_id") == second) & fires(first))
        more = F.when(F.col("rule_id") == first, F.concat(more, criteria_of(second))).otherwise(more)
    return rows.filter(~gone).withColumn("criteria", F.array_union("criteria", more)).drop("_here")


def identified(findings: DataFrame) -> DataFrame:
    return findings.withColumn("finding_id", finding_id(F.col("rule_id"), F.col("path"), F.col("line"), F.col("col")))


def rollups(findings: DataFrame) -> DataFrame:
    """Counts by rule, by file and by directory in one pass; info findings do not count."""
    rows = findings.filter("severity <> 'info'").withColumn("directory", F.regexp_replace("path", "/[^/]*$", ""))
    names = [F.col("rule_id"), F.col("path"), F.col("directory")]
    sums = rows.groupingSets([[c] for c in names], *names).agg(F.grouping_id().alias("_set"), F.count("*").alias("findings"))
    return sums.select(F.when(F.col("_set") == 3, "rule").when(F.col("_set") == 5, "file").otherwise("directory").alias("kind"), F.coalesce(*names).alias("name"), "findings")


def top(counts: DataFrame, k: int) -> DataFrame:
    """The k largest of each kind, ties by name."""
    order = Window.partitionBy("kind").orderBy(F.desc("findings"), "name")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def collapse(findings: DataFrame, key: list[str]) -> DataFrame:
    """One row a group: the first finding in order of path and line, and the number of them."""
    return findings.groupBy(*key).agg(F.min(F.struct("path", "line", "col")).alias("first"), F.count("*").alias("occurrences"), F.count_distinct("path").alias("paths"))


def baseline_diff(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """state (new, grandfathered, resolved) of findings and of baseline entries, by ``hash``."""
    now, old = findings.select("hash").distinct(), baseline.select("hash").distinct()
    state = lambda d, s: d.withColumn("state", F.lit(s))
    return state(now.join(old, "hash", "left_anti"), "new").unionByName(state(now.join(old, "hash", "left_semi"), "grandfathered")).unionByName(state(old.join(now, "hash", "left_anti"), "resolved"))


def in_hunks(findings: DataFrame, hunks: DataFrame) -> DataFrame:
    """Findings on changed lines; hunks: path, start, stop (both included)."""
    return findings.join(hunks, (findings["path"] == hunks["path"]) & findings["line"].between(hunks["start"], hunks["stop"]), "left_semi")


def as_of(events: DataFrame, states: DataFrame, key: list[str], at: str, since: str, value: str) -> DataFrame:
    """For each event the latest state at or before it, by one window over both: states
    sort before events of the same time, and the last value before an event is carried."""
    e = events.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*events.columns).alias("_event"), F.lit(None).cast(states.schema[value].dataType).alias("_value"))
    s = states.select(*key, F.col(since).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(e.schema["_event"].dataType).alias("_event"), F.col(value).alias("_value"))
    order = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return e.unionByName(s).withColumn("_last", F.last("_value", ignorenulls=True).over(order)).filter("_kind = 1").select("_event.*", F.col("_last").alias(value))
