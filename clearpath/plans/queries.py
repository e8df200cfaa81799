"""Queries by name, and the same in DuckDB SQL. Rules run over markup made from the
``part`` table: by switches, so that SQL counts by the predicate (``rule_cases``), or
with a defect in every so-many-th row; the page queries run over ``pages`` itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.color import contrast
from ..functions.text import finding_id, phrase
from ..operators import findings as f
from ..operators import reports
from ..operators.finders import run_finders
from ..operators.registry import RULES, run_rules
from ..operators.rules import GENERIC
from ..streaming.watch import counts_by_window
from . import standards
from .audit import audit, pages_as_files, tables
from .cases import CASES
from .rule_cases import RULE_CASES
from . import feature_queries, scope_queries
from .switches import FINDER_CASES, counted, oracle, parts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def every(rule_id: str) -> int:
    """The defect's distance for a rule: 3 to 12."""
    return 3 + sum(map(ord, rule_id)) % 10


def rule_query(rule_id: str) -> Callable[[SparkSession, str], DataFrame]:
    if rule_id in RULE_CASES:
        return counted(lambda files: run_rules(tables(files), [rule_id]), RULE_CASES[rule_id])
    ext, bad, _, good = CASES[rule_id]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        part = parts(spark, sf_dir)
        source = F.when(F.col("p_partkey") % every(rule_id) == 0, bad).otherwise(good)
        files = part.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/"), F.col("p_partkey").cast("string"), F.lit(f".{ext}")).alias("path"), source.alias("source"))
        return run_rules(tables(files), [rule_id]).groupBy("file_id").agg(F.count("*").alias("findings"))

    return run


#: Pages of a task: the splits of their file would leave its parsing to as many tasks as it has row groups.
PAGES_A_TASK = 250


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as files, dealt to tasks by number of pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return pages_as_files(pages.repartition(-(-pages.count() // PAGES_A_TASK) or 1, "page_id"))


def page_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of all rules that read markup."""
    return audit(page_files(spark, sf_dir), [r for r, c in CASES.items() if c[0] == "html"])


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_findings(spark, sf_dir).groupBy("rule_id").agg(F.count("*").alias("findings"), F.count_distinct("file_id").alias("pages"))


def page_generic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = page_files(spark, sf_dir)
    return run_rules(tables(files), ["navigation/link-descriptive-text"]).groupBy(F.col("file_id").alias("page_id")).agg(F.count("*").alias("findings"))


def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(page_files(spark, sf_dir))
    return t.nodes.filter("tag in ('a', 'li', 'p', 'h1', 'nav', 'footer')").groupBy("tag").agg(F.count("*").alias("elements"))


def page_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-identical sources: one representative each."""
    rows = table(spark, sf_dir, "pages").groupBy(F.sha2("html", 256).alias("fingerprint")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("copies"))
    return rows


def derived_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings made from line items: rule from the return flag, path from the part,
    severity from the line status."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(
        F.concat(F.lit("rule/"), "l_returnflag").alias("rule_id"), F.concat(F.lit("dir"), (F.col("l_partkey") % 7).cast("string"), F.lit("/f"), (F.col("l_partkey") % 50).cast("string"), F.lit(".html")).alias("path"),
        F.col("l_linenumber").cast("int").alias("line"), (F.col("l_suppkey") % 5).cast("int").alias("col"), F.when(F.col("l_linestatus") == "O", "error").otherwise(F.when(F.col("l_linenumber") == 7, "info").otherwise("warning")).alias("severity"),
    )


def rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.rollups(derived_findings(spark, sf_dir))


def top_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return f.top(f.rollups(derived_findings(spark, sf_dir)), 10).select("kind", "name", "findings", "rank")


def collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = f.collapse(derived_findings(spark, sf_dir), ["rule_id", "line"])
    return rows.select("rule_id", "line", F.col("first.path").alias("first_path"), "occurrences", "paths")


def ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_findings(spark, sf_dir).select(finding_id(F.col("rule_id"), F.col("path"), F.col("line"), F.col("col")).alias("finding_id")).groupBy("finding_id").agg(F.count("*").alias("n"))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = lambda d: d.select(F.sha2(F.col("o_custkey").cast("string"), 256).alias("hash"))
    return f.baseline_diff(key(o.filter("o_orderstatus <> 'F'")), key(o.filter("o_orderstatus <> 'O'"))).groupBy("state").agg(F.count("*").alias("n"))


def hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived_findings(spark, sf_dir)
    changed = table(spark, sf_dir, "part").select(F.concat(F.lit("dir"), (F.col("p_partkey") % 7).cast("string"), F.lit("/f"), (F.col("p_partkey") % 50).cast("string"), F.lit(".html")).alias("path"), (F.col("p_size") % 4).cast("int").alias("start"), (F.col("p_size") % 4 + 1).cast("int").alias("stop")).distinct()
    return f.in_hunks(rows, changed).groupBy("rule_id", "line").agg(F.count("*").alias("findings"))


def attested_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the id of the user's latest earlier event of another type."""
    e = table(spark, sf_dir, "events")
    buys = e.filter("event_type = 'purchase'").select("user_id", "event_id", "ts")
    seen = e.filter("event_type <> 'purchase'").groupBy("user_id", "ts").agg(F.max("event_id").alias("last_seen"))
    return f.as_of(buys, seen, ["user_id"], "ts", "ts", "last_seen").select("event_id", "last_seen")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts_by_window(table(spark, sf_dir, "events")).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm"))


def level_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading rule's window over line numbers of orders."""
    l = table(spark, sf_dir, "lineitem").withColumn("level", (F.col("l_quantity") % 4).cast("int"))  # noqa: E741
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return l.withColumn("before", F.lag("level").over(order)).filter("level > before + 1").groupBy("level").agg(F.count("*").alias("skips"))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", phrase(F.concat(F.lit("  "), "p_name", F.lit(" » "))).alias("phrase"))
    return p


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grey = lambda c: F.concat(F.lit("#"), F.repeat(F.lpad(F.lower(F.hex(c)), 2, "0"), 3))
    p = table(spark, sf_dir, "part").select("p_partkey", F.round(contrast(grey(F.col("p_partkey") % 256), F.lit("white")), 6).alias("ratio"))
    return p


def criteria_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.criteria(spark).groupBy("standard_id").agg(F.count("*").alias("criteria"), F.count_if(F.col("automatable") == "manual").alias("manual"))


def closure_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standards.closure(spark).groupBy("criterion_id").agg(F.count("*").alias("reaches")).groupBy("reaches").agg(F.count("*").alias("criteria"))


def page_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = standards.cited(spark, page_findings(spark, sf_dir), ["wcag22"], "AA")
    return reports.coverage(found, standards.criteria(spark).filter("standard_id = 'wcag22'"))


def page_vpat(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = standards.cited(spark, page_findings(spark, sf_dir), ["wcag22"], "AA")
    none = spark.createDataFrame([], "criterion_id string, verdict string")
    return reports.vpat(found, standards.criteria(spark).filter("standard_id = 'wcag22'"), none, "AA").groupBy("term").agg(F.count("*").alias("criteria"))


def suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = parts(spark, sf_dir)
    comment = F.when(F.col("p_partkey") % 3 == 0, "<!-- a11y-disable-next-line media/alt-text-missing -- known -->\n").when(F.col("p_partkey") % 3 == 1, "<!-- a11y-disable-next-line other/rule -->\n").otherwise("\n")
    files = part.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".html")).alias("path"), F.concat(comment, F.lit('<img src="x">')).alias("source"))
    return f.suppress(run_rules(tables(files), ["media/alt-text-missing"]), files).groupBy("file_id").agg(F.count("*").alias("findings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "page_totals": page_totals, "page_generic_links": page_generic_links, "page_elements": page_elements, "page_fingerprints": page_fingerprints, "page_coverage": page_coverage, "page_vpat": page_vpat,
    "findings_rollups": rollups, "findings_top": top_files, "findings_collapsed": collapsed, "findings_ids": ids, "findings_suppressed": suppressed, "baseline_diff": baseline, "hunk_range_join": hunks, "as_of_join": attested_commit,
    "window_counts": hourly, "level_skips": level_skips, "phrase_normalised": phrases, "contrast_ratio": contrasts, "criteria_counts": criteria_counts, "closure_sizes": closure_sizes,
} | {"rule_" + r.replace("/", "_").replace("-", "_"): rule_query(r) for r in sorted(CASES)}
QUERIES |= {"finder_" + r.replace("/", "_").replace("-", "_"): counted(lambda files, r=r: run_finders(tables(files), [r]), c) for r, c in sorted(FINDER_CASES.items())}

_FINDINGS = """SELECT 'rule/' || l_returnflag AS rule_id, 'dir' || (l_partkey % 7) AS directory, 'dir' || (l_partkey % 7) || '/f' || (l_partkey % 50) || '.html' AS path, l_linenumber AS line, l_suppkey % 5 AS col,
  CASE WHEN l_linestatus = 'O' THEN 'error' WHEN l_linenumber = 7 THEN 'info' ELSE 'warning' END AS severity FROM lineitem"""
_ROLLUPS = f"""SELECT kind, name, count(*) AS findings FROM (SELECT unnest(['rule', 'file', 'directory']) AS kind, unnest([rule_id, path, directory]) AS name FROM ({_FINDINGS}) WHERE severity <> 'info') GROUP BY ALL"""
_LINKS = """SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*>([^<]*)</a>', 1)) AS t FROM pages"""
_GENERIC = f"""SELECT page_id FROM ({_LINKS}) WHERE trim(regexp_replace(lower(trim(regexp_replace(t, '\\s+', ' ', 'g'))), '[.!?→>»…\\s]+$', '')) IN ({", ".join("'" + g + "'" for g in GENERIC)})"""

ORACLE_SQL: dict[str, str] = {
    "page_generic_links": f"SELECT page_id, count(*) AS findings FROM ({_GENERIC}) GROUP BY page_id",
    "page_totals": f"""SELECT 'navigation/link-descriptive-text' AS rule_id, count(*) AS findings, count(DISTINCT page_id) AS pages FROM ({_GENERIC}) HAVING count(*) > 0
        UNION ALL SELECT 'semantics/landmark-main', count(*), count(*) FROM pages WHERE html LIKE '%<nav%' AND html NOT LIKE '%<main%' HAVING count(*) > 0
        UNION ALL SELECT 'navigation/skip-link', count(*), count(*) FROM pages WHERE len(regexp_extract_all(html, '<a ')) >= 2 AND html NOT LIKE '%href="#%' HAVING count(*) > 0""",
    "page_elements": " UNION ALL ".join(f"SELECT '{t}' AS tag, sum(len(regexp_extract_all(html, '<{t}[ >]')))::BIGINT AS elements FROM pages" for t in ("a", "li", "p", "h1", "nav", "footer")),
    "page_fingerprints": "SELECT sha256(html) AS fingerprint, min(page_id) AS page_id, count(*) AS copies FROM pages GROUP BY 1",
    "findings_rollups": _ROLLUPS,
    "findings_top": f"SELECT kind, name, findings, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY findings DESC, name) AS rank FROM ({_ROLLUPS})) WHERE rank <= 10",
    "findings_collapsed": f"SELECT rule_id, line, min(path) AS first_path, count(*) AS occurrences, count(DISTINCT path) AS paths FROM ({_FINDINGS}) GROUP BY ALL",
    "findings_ids": f"SELECT substr(sha256(rule_id || ' ' || path || ' ' || line || ' ' || col), 1, 12) AS finding_id, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1",
    "findings_suppressed": "SELECT p_partkey AS file_id, 1::BIGINT AS findings FROM part WHERE p_partkey % 3 <> 0",
    "closure_sizes": f"""WITH s AS (SELECT string_split(unnest(string_split('{standards.SHARED}', ' ')), '/') AS x), n AS (SELECT string_split(unnest(string_split('{standards.ADDED_22}', ' ')), '/') AS x),
        r AS (SELECT x[1] AS id, 1 + (x[1] <> '4.1.1')::INT + (x[2] <> 'AAA')::INT + (x[2] <> 'AAA' AND NOT list_contains(string_split('{standards.ADDED_21}', ' '), x[1]))::INT AS size FROM s)
        SELECT reaches, sum(criteria)::BIGINT AS criteria FROM (SELECT size::BIGINT AS reaches, size AS criteria FROM r UNION ALL SELECT 1, 1 FROM n) GROUP BY 1""",
    "baseline_diff": """WITH a AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus <> 'F'), b AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_orderstatus <> 'O')
        SELECT state, count(*) AS n FROM (SELECT CASE WHEN b.c IS NULL THEN 'new' WHEN a.c IS NULL THEN 'resolved' ELSE 'grandfathered' END AS state FROM a FULL JOIN b ON a.c = b.c) GROUP BY state""",
    "hunk_range_join": f"""WITH h AS (SELECT 'dir' || (p_partkey % 7) || '/f' || (p_partkey % 50) || '.html' AS path, p_size % 4 AS a, p_size % 4 + 1 AS z FROM part)
        SELECT rule_id, line, count(*) AS findings FROM ({_FINDINGS}) x WHERE EXISTS (SELECT 1 FROM h WHERE h.path = x.path AND x.line BETWEEN a AND z) GROUP BY ALL""",
    "as_of_join": """SELECT b.event_id, s.last_seen FROM (SELECT * FROM events WHERE event_type = 'purchase') b
        ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS last_seen FROM events WHERE event_type <> 'purchase' GROUP BY ALL) s ON b.user_id = s.user_id AND b.ts >= s.ts""",
    "window_counts": "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "level_skips": """SELECT level, count(*) AS skips FROM (SELECT (l_quantity % 4)::INT AS level, lag((l_quantity % 4)::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS before FROM lineitem) WHERE level > before + 1 GROUP BY level""",
    "phrase_normalised": "SELECT p_partkey, trim(regexp_replace(lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))), '[.!?→>»…\\s]+$', '')) AS phrase FROM part",
    "contrast_ratio": """SELECT p_partkey, round(1.05 / ((CASE WHEN g / 255.0 <= 0.03928 THEN g / 255.0 / 12.92 ELSE pow((g / 255.0 + 0.055) / 1.055, 2.4) END)::DOUBLE + 0.05), 6)::DOUBLE AS ratio FROM (SELECT p_partkey, (p_partkey % 256)::DOUBLE AS g FROM part)""",
    "criteria_counts": f"""WITH s AS (SELECT string_split(unnest(string_split('{standards.SHARED}', ' ')), '/') AS x), n AS (SELECT string_split(unnest(string_split('{standards.ADDED_22}', ' ')), '/') AS x),
        a AS (SELECT 'wcag21' AS standard_id, x[3] AS how FROM s UNION ALL SELECT 'wcag22', x[3] FROM s WHERE x[1] <> '4.1.1' UNION ALL SELECT 'wcag22', x[3] FROM n UNION ALL SELECT 'en301549', x[3] FROM s WHERE x[2] <> 'AAA'
          UNION ALL SELECT 'section508', x[3] FROM s WHERE x[2] <> 'AAA' AND NOT list_contains(string_split('{standards.ADDED_21}', ' '), x[1]))
        SELECT standard_id, count(*) AS criteria, count(*) FILTER (how = 'm') AS manual FROM a GROUP BY standard_id""",
} | {"rule_" + r.replace("/", "_").replace("-", "_"): f"SELECT p_partkey AS file_id, {c[2]}::BIGINT AS findings FROM part WHERE p_partkey % {every(r)} = 0" for r, c in sorted(CASES.items())}

# What pages fail, from the findings that their text gives away, and the criteria of one standard.
_PAGE_STANDARD = f"""WITH failing AS (SELECT DISTINCT unnest(CASE rule_id WHEN 'semantics/landmark-main' THEN ['1.3.1'] WHEN 'navigation/skip-link' THEN ['2.4.1'] ELSE ['2.4.4', '4.1.2', '2.4.9'] END) AS number FROM ({ORACLE_SQL["page_totals"]})),
    c AS (SELECT string_split(unnest(string_split('{standards.SHARED} {standards.ADDED_22}', ' ')), '/') AS x),
    rows_ AS (SELECT x[2] AS level, x[3] AS how, f.number IS NOT NULL AS failed FROM c LEFT JOIN failing f ON f.number = x[1] WHERE x[1] <> '4.1.1')"""
ORACLE_SQL["page_coverage"] = f"""{_PAGE_STANDARD} SELECT 'wcag22' AS standard_id, count(*) AS criteria, count(*) FILTER (how <> 'm' OR failed) AS testable, count(*) FILTER (failed) AS failing, count(*) FILTER (how <> 'm' AND NOT failed) AS passing,
    round(100.0 * count(*) FILTER (how <> 'm' AND NOT failed) / count(*) FILTER (how <> 'm' OR failed))::BIGINT AS pass_rate FROM rows_"""
ORACLE_SQL["page_vpat"] = f"""{_PAGE_STANDARD} SELECT CASE WHEN failed THEN 'Partially Supports' WHEN level = 'AAA' THEN 'Not Applicable' WHEN how IN ('m', 'p') THEN 'Not Evaluated' ELSE 'Supports' END AS term, count(*) AS criteria FROM rows_ GROUP BY 1"""
ORACLE_SQL |= {"rule_" + r.replace("/", "_").replace("-", "_"): oracle(c) for r, c in RULE_CASES.items()}
ORACLE_SQL |= {"finder_" + r.replace("/", "_").replace("-", "_"): oracle(c) for r, c in sorted(FINDER_CASES.items())}
QUERIES |= scope_queries.QUERIES
ORACLE_SQL |= scope_queries.ORACLE_SQL
QUERIES |= feature_queries.QUERIES
ORACLE_SQL |= feature_queries.ORACLE_SQL

assert set(CASES) <= set(RULES)
