"""Queries of the cascade, scripts, processes, stores and SQL functions, with their SQL. Their
markup is made from columns by switches, so SQL tells the findings from the switches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sql
from ..operators.cascade import cascaded, text_contrast
from ..operators.processes import changed_along, of_processes
from ..operators.registry import run_rules
from ..operators.scripts import dom_actions
from ..operators.findings import pragmas
from ..operators.wrappers import with_components
from ..sources.html import read_errors
from .audit import pages_as_files, tables
from .project import audit_project, groups
from .switches import Case, counted, files, one, oracle, two, when

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def switched(name: str, case: Case, run: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name], ORACLE_SQL[name] = counted(run, case), oracle(case)


def alone(f: DataFrame) -> DataFrame:
    """Each row of the part table is a project."""
    return f.withColumn("project", F.regexp_extract("path", r"src/(\d+)-", 1))


# ---- the cascade ------------------------------------------------------------------------
_SHEET = "<html><head><style>body {{ background: #fff }} p {{ color: {a} }} {s} {{ color: {b} }}</style></head><body><div class=\"{c}\"><p id=\"i\"{i}>x</p></div></body></html>".replace("{{", "{ ").replace("}}", " }")
_STYLES = dict(a=["#222", "#888", "#222 !important"], s=["div p", ".k > p", "#i", "em p", "p", "body .k p", "p:hover"], b=["#777", "#111"], c=["k", "z"], i=["", ' style="color: #999"'])
_MATCH = "(s IN ('div p', '#i', 'p') OR s IN ('.k > p', 'body .k p') AND c = 'k')"
_COLOUR = f"CASE WHEN a LIKE '%important' THEN '#222' WHEN i <> '' THEN '#999' WHEN {_MATCH} THEN b ELSE a END"
switched("cascade_contrast", one("html", _SHEET, when(f"{_COLOUR} IN ('#777', '#888', '#999')"), **_STYLES), lambda f: text_contrast(tables(f), 3).filter("ratio < if(large, 3, 4.5)"))
switched("cascade_winner", one("html", _SHEET, when(f"({_COLOUR}) = b"), **_STYLES), lambda f: cascaded(tables(f), ["color"], 3).filter("value in ('#777', '#111')"))

# ---- scripts ----------------------------------------------------------------------------
_PAIR = two(
    ("html", '<{t} id="{i}">x</{t}>'), ("js", "const b = document.getElementById('go');\n{u};\n"), "", t=["div", "button"], i=["go", "stop"],
    u=["b.onclick = f", "// b.onclick = f", "say('b.onclick = f')", "function q() { b.addEventListener('click', f) }", "c.onclick = f", "{ const b = document.querySelector('#other'); b.onclick = f }", "document.getElementById('go')?.addEventListener(\"click\", f)"],
)
_WIRED = "(u LIKE 'b.%' OR u LIKE 'function%' OR u LIKE 'document%')"
switched("script_bindings", Case(_PAIR.templates, _PAIR.switches, f"SELECT k * 2 + 1 AS file_id, 1::BIGINT AS findings FROM v WHERE {_WIRED} OR u LIKE '{{{{ const%'".replace("{{", "{")), lambda f: dom_actions(tables(f)).filter("what = 'event' and detail = 'click'"))
switched("script_controls", Case(_PAIR.templates, _PAIR.switches, when(f"{_WIRED} AND t = 'div' AND i = 'go'")), lambda f: run_rules(tables(alone(f)), ["keyboard/interactive-div-role-missing"]))
switched(
    "script_click_without_keys", Case(_PAIR.templates, _PAIR.switches, f"SELECT k * 2 + 1 AS file_id, 1::BIGINT AS findings FROM v WHERE {_WIRED} AND NOT (t = 'button' AND i = 'go') OR u LIKE '{{{{ const%'".replace("{{", "{")),
    lambda f: run_rules(tables(alone(f)), ["keyboard/handler-missing"]),
)

# ---- processes: parts of one size are the steps of a process, in order of their key ----------
_STEP = one("html", '<button data-testid="go">{x}</button>', "", x=["Next", "Go on", "Next"])


def process_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_size").alias("process"), F.col("p_partkey").alias("ord"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit("-0.html")).alias("path"))
    t = tables(of_processes(files(spark, sf_dir, _STEP), steps))
    return changed_along(t).groupBy("project").agg(F.count("*").alias("changes"))


QUERIES["process_changes"] = process_changes
ORACLE_SQL["process_changes"] = """SELECT p_size::VARCHAR AS project, count(*) AS changes FROM (SELECT p_size, p_partkey % 3 = 1 AS odd, lag(p_partkey % 3 = 1) OVER (PARTITION BY p_size ORDER BY p_partkey) AS before FROM part) WHERE odd <> before GROUP BY p_size"""


# ---- SQL alone --------------------------------------------------------------------------
def sql_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    sql.register(spark)
    return spark.sql(f"SELECT p.page_id, count(*) AS links, max(length(e.text)) AS longest FROM parquet.`{sf_dir}/pages.parquet` p, LATERAL markup_elements(p.html) e WHERE e.tag = 'a' GROUP BY p.page_id")


def sql_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages_as_files(spark.read.parquet(f"{sf_dir}/pages.parquet")).createOrReplaceTempView("clearpath_pages")
    sql.views(spark, "clearpath_pages", ["navigation/skip-link", "semantics/landmark-main", "media/alt-text-missing"])
    return spark.sql("SELECT rule_id, count(*) AS findings FROM findings GROUP BY rule_id")


QUERIES |= {"sql_elements": sql_elements, "sql_findings": sql_findings}
ORACLE_SQL["sql_elements"] = "SELECT page_id, count(*) AS links, max(len(trim(t)))::INT AS longest FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS t FROM pages) GROUP BY page_id"
ORACLE_SQL["sql_findings"] = """SELECT 'semantics/landmark-main' AS rule_id, count(*) AS findings FROM pages WHERE html LIKE '%<nav%' AND html NOT LIKE '%<main%' HAVING count(*) > 0
    UNION ALL SELECT 'navigation/skip-link', count(*) FROM pages WHERE len(regexp_extract_all(html, '<a ')) >= 2 AND html NOT LIKE '%href="#%' HAVING count(*) > 0"""

# ---- what readers get over, and where comments are comments -----------------------------
switched(
    "parse_errors", one("html", "<div>{a}<h2 {d}>x{b}</h2>{c}</div>", when("a = '</i>'") + " + " + when("b = '</u>'") + " + " + when("c IN ('<!-- x', '<script>y')", 2) + " + " + when("c = '<em>'", 3) + " + " + when("d LIKE '%id%id%'"), a=["", "</i>", "<b>y</b>", "<code></i></code>"], b=["", "</u>"], c=["", "<!-- x", "<script>y", "<em>"], d=["id=a", "id=a id=b"]),
    read_errors,
)
switched(
    "pragma_carriers", one("js", "{a} a11y-disable-line media/alt-text-missing {z}\n", when("a IN ('//', 'x(); //', '/*', '`${x}` /*')"), a=["//", "x(); //", "/*", "`${x}` /*", "'//", "`/*", "/[/*]/.test('"], z=["*/ `'"]),
    lambda f: pragmas(f),
)

# ---- components through several files ---------------------------------------------------
_PARTS = Case(
    (("Base.tsx", "const B = () => <{r}>x</{r}>;"), ("Button.tsx", "const B = () => <Base>y</Base>;"), ("Loop.tsx", "const L = () => <Loop />;"), ("tsx", "const P = () => <main><Button{a}></Button><Loop /><Nowhere /></main>;")),
    dict(r=["button", "div", "button"], a=["", ' as="a"', ' title="x"', " asChild"]), "SELECT k * 4 + 3 AS file_id, 1::BIGINT AS findings FROM v WHERE r = 'button' AND a = ''",
)
switched("component_roots", _PARTS, lambda f: run_rules(with_components(tables(alone(f))), ["semantics/button-name"]))

# ---- a whole project: copies once, groups of findings on elements of one shape ----------
_SHAPED = one("html", "<{t} {a}{b}>", "", t=["img", "input type=image"], a=["src=x", "class=y"], b=["", " id=q", " role=none"])


def project_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(audit_project(files(spark, sf_dir, _SHAPED), None, ["media/alt-text-missing"])).select("group_key", "occurrences", "paths")


QUERIES["project_groups"] = project_groups
ORACLE_SQL["project_groups"] = oracle(Case(_SHAPED.templates, _SHAPED.switches, """SELECT substr(sha256('media/alt-text-missing' || chr(0) || CASE WHEN t = 'img' THEN 'img' ELSE 'input' END || '[' || array_to_string(list_sort([x for x in [CASE WHEN t <> 'img' THEN 'type' END, string_split(a, '=')[1], CASE WHEN b <> '' THEN 'id' END] if x IS NOT NULL]), ',') || ']'), 1, 12) AS group_key,
    count(*) AS occurrences, count(*) AS paths FROM v WHERE b <> ' role=none' GROUP BY 1"""))
