"""Rules as functions from tables to findings, and their metadata."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sheets import Sheet, sheet_rows
from .tree import Hit, Place, placed


@dataclass(frozen=True)
class Tables:
    """What rules read: files (file_id, path, source), nodes (elements), css (declarations).
    As a context it gives back, at its end, what was persisted for it."""

    files: DataFrame
    nodes: DataFrame
    css: DataFrame | None = None
    made: dict[str, DataFrame] = field(default_factory=dict, compare=False, repr=False)
    counts: dict[str, int] = field(default_factory=dict, compare=False, repr=False)

    def elements(self) -> int:
        """How many elements there are; the first who asks has them parsed."""
        if "nodes" not in self.counts:
            self.counts["nodes"] = self.nodes.count()
        return self.counts["nodes"]

    def once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table that several rules derive from these: made and persisted by the first."""
        if name not in self.made:
            self.made[name] = make().persist(StorageLevel.MEMORY_AND_DISK)
        return self.made[name]

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *_) -> None:
        for d in (*self.made.values(), self.css, self.nodes):
            if d is not None:
                d.unpersist()
        self.made.clear()


@dataclass(frozen=True)
class Rule:
    """A rule asks about one element (``element``), an element's place (``place``), a rule of
    a style sheet (``sheet``), or is a query of its own (``find``)."""

    id: str
    criteria: tuple[str, ...]
    severity: str
    find: Callable[[Tables], DataFrame] | None = field(default=None, compare=False)
    fix_class: str = "verify-in-source"
    element: Callable[[], Column] | None = field(default=None, compare=False)
    message: str | Callable[[], Column] | None = field(default=None, compare=False)
    own_severity: Callable[[], Column] | None = field(default=None, compare=False)
    place: Callable[[Place], list[Hit]] | None = field(default=None, compare=False)
    sheet: Callable[[Sheet], list[Hit]] | None = field(default=None, compare=False)
    python: Callable[[pd.DataFrame], Iterable[str | None]] | None = field(default=None, compare=False)


RULES: dict[str, Rule] = {}


def rule(id_: str, criteria: str, severity: str, fix_class: str = "verify-in-source"):
    """Register ``find``: Tables -> file_id, line, col, message (and severity to override)."""

    def keep(find):
        RULES[id_] = Rule(id_, tuple(criteria.split()), severity, find, fix_class)
        return find

    return keep


def place_rule(id_: str, criteria: str, severity: str, fix_class: str = "verify-in-source"):
    """Register a function from ``Place`` to hits. All such rules share one plan."""

    def keep(place):
        RULES[id_] = Rule(id_, tuple(criteria.split()), severity, None, fix_class, place=place)
        return place

    return keep


def sheet_rule(id_: str, criteria: str, severity: str, fix_class: str = "verify-in-source"):
    """Register a function from ``Sheet`` to hits. All such rules share one plan."""

    def keep(sheet):
        RULES[id_] = Rule(id_, tuple(criteria.split()), severity, None, fix_class, sheet=sheet)
        return sheet

    return keep


def element_rule(id_: str, criteria: str, severity: str, condition: Callable[[], Column], message: str | Callable[[], Column], fix_class: str = "verify-in-source", own_severity: Callable[[], Column] | None = None) -> None:
    """A rule that looks at one element by itself; all such rules share one pass. A message
    that is a function gives a column: a text, or an array with a finding for each."""
    RULES[id_] = Rule(id_, tuple(criteria.split()), severity, None, fix_class, condition, message, own_severity)


def python_rule(id_: str, criteria: str, severity: str, fix_class: str = "verify-in-source"):
    """Register a function from some elements (pandas) to a message, or none, for each.
    All such rules share a pass, in which one that raises tells so for the files at hand."""

    def keep(python):
        RULES[id_] = Rule(id_, tuple(criteria.split()), severity, None, fix_class, python=python)
        return python

    return keep


CRASH = "internal/rule-crash"
SHAPE = ["file_id", "line", "col", "rule_id", "severity", "message"]


class Hits:
    """Conditions and what they tell, as two arrays: numbers of the rules whose message is
    fixed, and (number, message, severity, line) of the others."""

    def __init__(self):
        self.known: list[tuple[Rule, str | None, str | None]] = []
        self.fixed: list[Column] = []
        self.made: list[Column] = []

    def add(self, r: Rule, when: Column, message: str | Column, severity: str | Column | None = None) -> None:
        n, plain = len(self.known), isinstance(message, str) and not isinstance(severity, Column)
        self.known.append((r, message if isinstance(message, str) else None, severity if isinstance(severity, str) else r.severity))
        if plain:
            self.fixed.append(F.when(when, n))
        else:
            said = F.lit(None).cast("string") if isinstance(message, str) else message
            level = severity if isinstance(severity, Column) else F.expr("cast(null as string)")
            self.made.append(F.when(when, F.array(F.struct(F.lit(n).alias("n"), said.alias("message"), level.alias("severity"), F.col("line").cast("int").alias("line")))))

    def each(self, r: Rule, when: Column, rows: Column, message: Callable, line: Callable) -> None:
        """A hit for each entry of an array."""
        n = len(self.known)
        self.known.append((r, None, r.severity))
        self.made.append(F.when(when, F.transform(rows, lambda x: F.struct(F.lit(n).alias("n"), message(x).alias("message"), F.expr("cast(null as string)").alias("severity"), line(x).cast("int").alias("line")))))

    def found(self, rows: DataFrame) -> DataFrame:
        empty = F.expr("cast(array() as array<struct<n:int,message:string,severity:string,line:int>>)")
        fixed = F.transform(F.array_compact(F.array(*self.fixed)), lambda n: F.struct(n.alias("n"), F.expr("cast(null as string)").alias("message"), F.expr("cast(null as string)").alias("severity"), F.col("line").cast("int").alias("line"))) if self.fixed else empty
        made = F.flatten(F.array_compact(F.array(*self.made))) if self.made else empty
        hit = rows.select("file_id", "col", F.explode(F.concat(fixed, made)).alias("hit"))
        text = lambda x: "null" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
        column = lambda values: "array(" + ", ".join(map(text, values)) + ")[hit.n]"
        return hit.selectExpr("file_id", "hit.line as line", "col", column(k[0].id for k in self.known) + " as rule_id", f"coalesce(hit.severity, {column(k[2] for k in self.known)}) as severity", f"coalesce(hit.message, {column(k[1] for k in self.known)}) as message")


_compiled: dict[tuple, tuple] = {}


def _once(t: Tables, kind: str, rules: list[Rule], make: Callable[[], tuple]) -> tuple:
    """What ``make`` builds of rules, kept for the next run of the same rules (as of a
    stream's next batch): columns belong to no table. The last few sets are kept."""
    key = (kind, t.files.sparkSession.sparkContext.applicationId, *map(id, rules))
    if key not in _compiled:
        while len(_compiled) >= 12:
            del _compiled[next(iter(_compiled))]
        _compiled[key] = (rules, *make())  # the rules live as long as their ids stand for them
    return _compiled[key][1:]


def _of_elements(t: Tables, rules: list[Rule]) -> DataFrame:
    (hits,) = _once(t, "element", rules, lambda: (_element_hits(rules),))
    return hits.found(t.nodes)


def _element_hits(rules: list[Rule]) -> Hits:
    hits = Hits()
    for r in rules:
        if getattr(r.message, "many", False):
            hits.each(r, r.element(), r.message(), lambda m: m, lambda m: F.col("line"))
        else:
            hits.add(r, r.element(), r.message if isinstance(r.message, str) else r.message(), r.own_severity() if r.own_severity else None)
    return hits


def _of_places(t: Tables, rules: list[Rule]) -> DataFrame:
    place, hits = _once(t, "place", rules, lambda: _place_hits(rules))
    return hits.found(placed(t.nodes, t.files, place, t.elements()))


def _place_hits(rules: list[Rule]) -> tuple[Place, Hits]:
    place, hits, kinds = Place(), Hits(), {}
    for r in rules:
        for h in r.place(place):
            kind = kinds.setdefault(h.on, F.expr(f"mention.kind = '{h.on}'"))
            hits.add(r, kind & h.when, h.message, h.severity)
    return place, hits


def of_sheets(t: Tables, rules: list[Rule]) -> DataFrame:
    sheet, hits = _once(t, "sheet", rules, lambda: _sheet_hits(rules))
    return hits.found(sheet.rows(t.once("sheet rules", lambda: sheet_rows(t.css))).withColumn("col", F.lit(1)))


def _sheet_hits(rules: list[Rule]) -> tuple[Sheet, Hits]:
    sheet, hits = Sheet(), Hits()
    for r in rules:
        for h in r.sheet(sheet):
            if h.on == "each":
                hits.each(r, h.when, h.message, lambda x: x["message"], lambda x: x["line"])
            else:
                hits.add(r, h.when, h.message, h.severity)
    return sheet, hits


def _of_python(t: Tables, rules: list[Rule]) -> DataFrame:
    known = [(r.id, r.severity, r.python) for r in rules]

    def run(batches):
        for rows in batches:
            for id_, severity, python in known:
                try:
                    said = pd.Series(list(python(rows)), index=rows.index, dtype=object)
                    told = rows.loc[said.notna(), ["file_id", "line", "col"]].assign(rule_id=id_, severity=severity, message=said.dropna().astype(str))
                except Exception as e:  # noqa: BLE001  whatever a rule raises is reported
                    told = rows[["file_id"]].drop_duplicates().assign(line=1, col=1, rule_id=CRASH, severity="error", message=f"{id_} failed: {type(e).__name__}")
                yield told

    columns = [f for f in t.nodes.columns if f not in ("attrs", "ancestors")]
    found = t.nodes.select(*columns, F.map_entries("attrs").alias("attrs")).mapInPandas(run, "file_id long, line int, col int, rule_id string, severity string, message string")
    crashes = found.filter(F.col("rule_id") == CRASH).distinct()  # one a file, however many batches it came in
    return found.filter(F.col("rule_id") != CRASH).unionByName(crashes)


def many(made: Callable[[], Column]) -> Callable[[], Column]:
    """Marks a message that is an array: a finding for each of its texts."""
    made.many = True
    return made


def _parts(t: Tables, rules: list[Rule]) -> list[DataFrame]:
    """The branches of the plan of these rules."""
    parts = []
    for kind, run in (("element", _of_elements), ("place", _of_places), ("sheet", of_sheets), ("python", _of_python)):
        if (some := [r for r in rules if getattr(r, kind)]) and (kind != "sheet" or t.css is not None):
            parts.append(run(t, some))
    for r in rules:
        if r.find:
            found = r.find(t)
            own = F.col("severity") if "severity" in found.columns else F.lit(r.severity)
            parts.append(found.select("file_id", "line", "col", F.lit(r.id).alias("rule_id"), own.alias("severity"), "message"))
    return parts


def run_rules(t: Tables, ids: list[str] | None = None) -> DataFrame:
    """file_id, path, line, col, rule_id, criteria, severity, fix_class and message of
    every finding. Rules on single elements share a pass, rules on places share one shuffle
    by file, rules on style sheets another; each evaluates its rules as an array of hits. So
    the plan has a few branches, however many rules there are."""
    chosen = [RULES[i] for i in (ids or sorted(RULES))]
    return described(t, _parts(t, chosen), chosen)


def described(t: Tables, parts: list[DataFrame], rules: list[Rule]) -> DataFrame:
    """Findings of all parts with their rules' criteria and their files' paths."""
    out = parts[0].select(SHAPE)
    for p in parts[1:]:
        out = out.unionByName(p.select(SHAPE))
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    kinds = ", ".join(f"{quoted(r.id)}, named_struct('criteria', cast(array({', '.join(map(quoted, r.criteria))}) as array<string>), 'fix_class', {quoted(r.fix_class)})" for r in rules)
    # Findings of many files look small where they are packed, and are not: neither side is for the driver.
    out = out.withColumn("_r", F.expr(f"map({kinds})[rule_id]")).join(t.files.select("file_id", "path").hint("merge"), "file_id")
    return out.selectExpr("file_id", "path", "line", "col", "rule_id", "coalesce(_r.criteria, cast(array() as array<string>)) as criteria", "severity", "coalesce(_r.fix_class, 'verify-in-source') as fix_class", "message")


def run_isolated(t: Tables, ids: list[str] | None = None) -> DataFrame:
    """``run_rules``, where a rule that fails gives one error for each file and the others
    stand; still one plan and one job. A rule whose condition or query cannot be built fails
    while the plan is made, before any row is read; a Python rule fails in its task, where
    that is caught. A native condition that fails on a row (as by a cast that may not fail)
    fails the job: conditions are to be total."""
    sound, failed = [], []
    for r in (RULES[i] for i in (ids or sorted(RULES))):
        try:
            if not r.python:
                _parts(t, [r])
            sound.append(r)
        except Exception as e:  # noqa: BLE001  whatever a rule raises is reported
            failed.append((r.id, type(e).__name__))
    parts = _parts(t, sound)
    if failed:
        told = F.explode(F.array(*(F.lit(f"{i} failed: {e}") for i, e in failed)))
        parts.append(t.files.select("file_id", F.lit(1).alias("line"), F.lit(1).alias("col"), F.lit(CRASH).alias("rule_id"), F.lit("error").alias("severity"), told.alias("message")))
    return described(t, parts, sound or [RULES[ids[0]]])
