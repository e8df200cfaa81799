"""What scripts do to elements: bindings of names to selectors, and events on them.

A selection is ``getElementById('x')`` or ``querySelector('#x')``. A binding is a selection
that a name is declared or assigned as; it holds in the scope of the declaration and those
within. A use of the name means the binding of the innermost scope around it, of equal ones
the latest before the use. What is done to a selection, directly or by name, is one row:
``event`` (of ``addEventListener`` or an ``on`` property) or ``text`` (a write of its content).

All is windows over neighbouring tokens and an equi-join by (file, script, name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scripts import SCRIPTS, script_tokens
from .registry import Tables

WRITES = ["innerHTML", "textContent", "innerText"]
#: Words without one of which a script does nothing that is looked for.
SELECTS = r"getElementById|querySelector"


def script_sources(t: Tables, pattern: str) -> DataFrame:
    """Script files and script elements that match: file_id, script, first_line, source."""
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    whole = t.files.filter(ext.isin(*SCRIPTS) & F.col("source").rlike(pattern)).select("file_id", F.lit(0).alias("script"), F.lit(1).alias("first_line"), "source")
    inner = t.nodes.filter((F.col("tag") == "script") & F.col("text").rlike(pattern)).select("file_id", F.col("node_id").alias("script"), F.col("line").alias("first_line"), F.col("text").alias("source"))
    return whole.unionByName(inner)


def _next(k: int, name: str = "text") -> Column:
    order = Window.partitionBy("file_id", "script").orderBy("n")
    return F.lead(name, k).over(order) if k > 0 else F.lag(name, -k).over(order)


def _selector(method: Column, argument: Column) -> Column:
    """(kind, token) of an id or class that a selection names by itself, else null."""
    by_id = F.when(method == "getElementById", argument).when(argument.rlike(r"^#[\w-]+$"), F.substring(argument, 2, 1_000_000))
    by_class = F.when((method != "getElementById") & argument.rlike(r"^\.[\w-]+$"), F.substring(argument, 2, 1_000_000))
    return F.when(by_id.isNotNull(), F.struct(F.lit("id").alias("kind"), by_id.alias("token"))).when(by_class.isNotNull(), F.struct(F.lit("class").alias("kind"), by_class.alias("token")))


def _action(at: int) -> Column:
    """What is done to the value that ends just before the token ``at`` steps ahead: (what,
    detail), or null."""
    dot, name, then, argument = F.col(f"t{at}"), F.col(f"t{at + 1}"), F.col(f"t{at + 2}"), F.col(f"t{at + 3}")
    dotted = dot.isin(".", "?.")
    listens = dotted & (name == "addEventListener") & (then == "(") & (F.col(f"k{at + 3}") == "string")
    handles = dotted & name.rlike("^on[a-z]+$") & (then == "=")
    writes = dotted & name.isin(*WRITES) & then.isin("=", "+=")
    act = lambda what, detail: F.struct(F.lit(what).alias("what"), detail.alias("detail"))
    return F.when(listens, act("event", argument)).when(handles, act("event", F.substring(name, 3, 100))).when(writes, act("text", name))


def dom_actions(t: Tables) -> DataFrame:
    """file_id, line, col, kind and token (of the selector), what and detail. One a place."""
    tok = script_tokens(script_sources(t, SELECTS))
    # A selection is method ( 'x' ), so what is done to it begins four tokens on.
    ahead = {f"t{k}": _next(k) for k in (-4, -3, -2, -1, 1, 2, 3, 4, 5, 6, 7)} | {f"k{k}": _next(k, "kind") for k in (-4, 2, 4, 7)}
    tok = t.once("script tokens", lambda: tok.select("*", *(c.alias(n) for n, c in ahead.items())))
    selects = F.col("text").isin("getElementById", "querySelector", "querySelectorAll") & (F.col("kind") == "name") & (F.col("t1") == "(") & (F.col("k2") == "string") & (F.col("t3") == ")")
    made = tok.filter(selects).withColumn("selector", _selector(F.col("text"), F.col("t2"))).filter("selector is not null")
    direct = made.withColumn("act", _action(4)).filter("act is not null").select("file_id", "line", "col", "selector", "act")

    # ``name = document.getElementById(...)``, declared or not; the scope is the brace it stands in.
    bound = made.filter((F.col("t-1") == ".") & (F.col("t-3") == "=") & (F.col("k-4") == "name"))
    bound = bound.select("file_id", "script", F.col("t-4").alias("name"), F.col("n").alias("since"), F.col("scope").alias("within"), "selector")
    uses = tok.filter((F.col("kind") == "name") & F.coalesce(F.col("t-1") != ".", F.lit(True)))
    act = F.when(F.col("t1").isin(".", "?."), _use())
    uses = uses.withColumn("act", act).filter("act is not null").select("file_id", "script", "n", "line", "col", "scope", F.col("text").alias("name"), "act")
    pairs = uses.join(bound, ["file_id", "script", "name"]).filter(F.col("scope").startswith(F.col("within")) & (F.col("since") < F.col("n")))
    latest = pairs.groupBy("file_id", "script", "n").agg(F.max_by(F.struct("line", "col", "selector", "act"), F.struct(F.length("within"), "since")).alias("p"))
    by_name = latest.select("file_id", "p.line", "p.col", "p.selector", "p.act")
    return direct.unionByName(by_name).select("file_id", "line", "col", "selector.kind", "selector.token", "act.what", "act.detail")


def _use() -> Column:
    """What is done to a name: its action begins with the next token."""
    name, then, argument = F.col("t2"), F.col("t3"), F.col("t4")
    act = lambda what, detail: F.struct(F.lit(what).alias("what"), detail.alias("detail"))
    listens = (name == "addEventListener") & (then == "(") & (F.col("k4") == "string")
    return F.when(listens, act("event", argument)).when(name.rlike("^on[a-z]+$") & (then == "="), act("event", F.substring(name, 3, 100))).when(name.isin(*WRITES) & then.isin("=", "+="), act("text", name))


def of_project(t: Tables, rows: DataFrame) -> DataFrame:
    """``rows`` with the project of their file: files of different projects never meet. Where
    files have no such column, all are one project. A table of all files is not for the driver,
    however small it looks before their rows are made."""
    if "project" not in t.files.columns:
        return rows.withColumn("project", F.lit(""))
    return rows.join(t.files.select("file_id", F.coalesce(F.col("project").cast("string"), F.lit("")).alias("project")).hint("merge"), "file_id")
