"""Reports over findings and criteria: coverage, checklist, conformance decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import criterion_order


def failing(findings: DataFrame) -> DataFrame:
    """(criterion_id, errors, others) of what findings cite, info left out."""
    rows = findings.filter("severity <> 'info'").select("severity", F.explode("cited").alias("criterion_id"))
    return rows.groupBy("criterion_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") != "error").alias("others"))


def coverage(findings: DataFrame, criteria: DataFrame) -> DataFrame:
    """By standard: criteria, those that can be tested, failing and passing ones, and the rate."""
    rows = criteria.join(failing(findings), "criterion_id", "left")
    failed = F.col("errors").isNotNull()
    testable = (F.col("automatable") != "manual") | failed
    out = rows.groupBy("standard_id").agg(F.count("*").alias("criteria"), F.count_if(testable).alias("testable"), F.count_if(failed).alias("failing"), F.count_if(testable & ~failed).alias("passing"))
    return out.withColumn("pass_rate", F.round(100.0 * F.col("passing") / F.col("testable")).cast("long"))


def by_level(findings: DataFrame, criteria: DataFrame) -> DataFrame:
    rows = criteria.join(failing(findings), "criterion_id", "left")
    return rows.groupBy("standard_id", "level").agg(F.count("*").alias("criteria"), F.count("errors").alias("failing"))


def checklist(findings: DataFrame, criteria: DataFrame) -> DataFrame:
    """Manual criteria that no finding cites, in numeric order."""
    rows = criteria.filter("automatable = 'manual'").join(failing(findings), "criterion_id", "left_anti")
    return rows.select("standard_id", "criterion_id", "local_id", "level", criterion_order(F.col("local_id")).alias("order"))


def ledger(findings: DataFrame, criteria: DataFrame, attestations: DataFrame) -> DataFrame:
    """Status of every criterion. attestations: criterion_id, verdict (pass, fail, n/a; null is pass)."""
    said = attestations.filter("coalesce(verdict, 'pass') <> 'pending'").groupBy("criterion_id").agg(*(F.max(F.coalesce(F.col("verdict"), F.lit("pass")) == v).alias(n) for n, v in (("said_pass", "pass"), ("said_fail", "fail"), ("said_na", "n/a"))))
    rows = criteria.join(failing(findings), "criterion_id", "left").join(said, "criterion_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = F.when(F.col("errors").isNotNull() | flag("said_fail"), "fail").when(flag("said_na"), "n/a").when(flag("said_pass"), "pass").when(F.col("automatable") != "manual", "pass").otherwise("unknown")
    return rows.withColumn("status", status)


def vpat(findings: DataFrame, criteria: DataFrame, attestations: DataFrame, level: str) -> DataFrame:
    """The conformance term of each criterion; the order of the cases is the rule."""
    rank = F.create_map(*(F.lit(x) for kv in (("A", 1), ("AA", 2), ("AAA", 3), ("base", 0)) for x in kv))
    said = attestations.filter("coalesce(verdict, 'pass') = 'pass'").select("criterion_id").distinct().withColumn("attested", F.lit(True))
    rows = criteria.join(failing(findings), "criterion_id", "left").join(said, "criterion_id", "left")
    attested = F.coalesce("attested", F.lit(False))
    term = (
        F.when(F.col("errors") > 0, "Does Not Support").when(F.col("others") > 0, "Partially Supports")
        .when(rank[F.col("level")] > {"A": 1, "AA": 2, "AAA": 3}.get(level, 3), "Not Applicable")
        .when(F.col("automatable") == "manual", "Not Evaluated").when((F.col("automatable") == "partial") & ~attested, "Not Evaluated")
        .when(F.col("automatable") == "partial", "Partially Supports").otherwise("Supports")
    )
    return rows.select("standard_id", "criterion_id", "level", term.alias("term"))


def certification(cover: DataFrame, manual_done: DataFrame) -> DataFrame:
    """Score by standard: 70 % pass rate, 30 % completed manual checks (column done, 0 to 1)."""
    return cover.join(manual_done, "standard_id").withColumn("score", F.round(100 * (0.7 * F.col("pass_rate") / 100 + 0.3 * F.col("done"))).cast("long"))


def evidence(findings: DataFrame, criteria: DataFrame, attestations: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every criterion with its sources in the order static, attested, candidate; static
    ones are sorted by finding id. attestations: criterion_id, verdict, rule_ids, by;
    candidates: criterion_id, candidate_id. A pass for some rules only is partial unless
    the attestations together cover all rules of the criterion (criteria: rules)."""
    static = findings.filter("severity <> 'info'").select(F.explode("cited").alias("criterion_id"), "finding_id").groupBy("criterion_id").agg(F.array_sort(F.collect_set("finding_id")).alias("static"))
    valid = attestations.withColumn("verdict", F.coalesce("verdict", F.lit("pass"))).filter("verdict <> 'pending'")
    flag = lambda v: F.bool_or(F.col("verdict") == v).alias(f"said_{v.replace('/', '')}")
    said = valid.groupBy("criterion_id").agg(
        flag("pass"), flag("fail"), flag("n/a"), F.array_sort(F.collect_set("by")).alias("attested"), F.bool_or((F.col("verdict") == "pass") & (F.size(F.coalesce("rule_ids", F.array().cast("array<string>"))) == 0)).alias("whole"),
        F.array_distinct(F.flatten(F.collect_list(F.when(F.col("verdict") == "pass", F.col("rule_ids"))))).alias("covered"),
    )
    asked = candidates.groupBy("criterion_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("candidates"))
    rows = criteria.join(static, "criterion_id", "left").join(said, "criterion_id", "left").join(asked, "criterion_id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    rules = F.coalesce(F.col("rules"), F.array().cast("array<string>")) if "rules" in criteria.columns else F.array().cast("array<string>")
    open_ = F.size(F.array_except(rules, F.coalesce("covered", F.array().cast("array<string>")))) > 0
    status = (
        F.when(F.col("static").isNotNull() | yes("said_fail"), "fail").when(yes("said_na"), "n/a").when(yes("said_pass") & ~yes("whole") & open_, "partial")
        .when(yes("said_pass"), "pass").when(F.col("automatable") != "manual", "pass").otherwise("unknown")
    )
    source = lambda kind, c: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("id")))
    return rows.withColumn("status", status).withColumn("sources", F.concat(source("static", "static"), source("attested", "attested"), source("candidate", "candidates"))).select(*criteria.columns, "status", "sources")


#: Criteria that only a running page can show.
RUNTIME_EVIDENCE = ["1.4.4", "1.4.10", "1.4.12", "1.4.13", "2.1.1", "2.1.2", "2.2.2", "2.3.1", "2.4.3", "2.4.7", "2.4.11"]


def conformance(ledger_rows: DataFrame, target: str, process_configured: bool, stale: DataFrame) -> DataFrame:
    """Each criterion in scope with its blocker, or null; the order of the cases is the rule.
    ledger_rows: from ``evidence``, with local_id and level; stale: criterion_id of
    attestations older than a change. A pass without any source is still no evidence."""
    rank = F.create_map(*(F.lit(x) for kv in (("A", 1), ("AA", 2), ("AAA", 3)) for x in kv))
    in_scope = (F.col("level") == "base") if target == "base" else (rank[F.col("level")] <= {"A": 1, "AA": 2, "AAA": 3}[target])
    rows = ledger_rows.filter(in_scope).join(stale.select("criterion_id").distinct().withColumn("stale", F.lit(True)), "criterion_id", "left")
    kinds = F.transform("sources", lambda s: s["kind"])
    attested, static = F.array_contains(kinds, "attested"), F.array_contains(kinds, "static")
    blocker = (
        F.when(F.lit(not process_configured), "missing-process-config").when(F.col("local_id").isin(RUNTIME_EVIDENCE) & ~attested & (F.col("status") != "fail"), "runtime-evidence").when(F.col("status") == "fail", "failing")
        .when(F.col("status") == "partial", "partially-attested").when(~attested & ~static & F.array_contains(kinds, "candidate"), "candidate-only").when((F.col("status") != "n/a") & ~attested & ~static, "no-evidence").when(F.coalesce("stale", F.lit(False)), "stale")
    )
    return rows.withColumn("blocker", blocker)


def conformant(rows: DataFrame) -> DataFrame:
    """One row: conformant, and numbers of criteria in scope and of blockers."""
    return rows.agg((F.count("blocker") == 0).alias("conformant"), F.count("*").alias("in_scope"), F.count("blocker").alias("blockers"))


def signature(rows: DataFrame) -> DataFrame:
    """A digest that equal sets of rows share, whatever their order: of the sorted digests
    of rows with their columns by name."""
    text = F.to_json(F.struct(*(F.col(c) for c in sorted(rows.columns))), {"ignoreNullFields": "false"})
    sums = rows.select(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("h")).agg(F.coalesce(F.sum("h"), F.lit(0)).alias("h"), F.count("*").alias("n"))
    return sums.select(F.sha2(F.concat_ws(" ", F.col("h").cast("string"), F.col("n").cast("string")), 256).alias("signature"), "n")


def drifted(now: DataFrame, signed: DataFrame) -> DataFrame:
    """(state, row) of rows that came or went since signing; none: the sets are equal."""
    state = lambda d, s: d.select(F.lit(s).alias("state"), F.to_json(F.struct(*sorted(d.columns))).alias("row"))
    return state(now.exceptAll(signed), "added").unionByName(state(signed.exceptAll(now), "removed"))


def certification_blockers(findings: DataFrame, k: int = 10) -> DataFrame:
    """The first k error findings in report order."""
    return findings.filter("severity = 'error'").orderBy("path", "line", "col", "rule_id").limit(k)


def rule_coverage(rules: DataFrame, eligible: DataFrame, findings: DataFrame) -> DataFrame:
    """By rule: eligible files, findings, files with findings, confidence, and the densest
    file where more than half of more than ten findings stand in one. rules: rule_id,
    cross_file (boolean), candidates (boolean: it saw some); eligible: rule_id, file_id."""
    files = eligible.groupBy("rule_id").agg(F.count("*").alias("eligible"))
    by_file = findings.groupBy("rule_id", "path").agg(F.count("*").alias("n"))
    sums = by_file.groupBy("rule_id").agg(F.sum("n").alias("findings"), F.count("*").alias("files"), F.min(F.struct((-F.col("n")).alias("minus"), "path")).alias("top"))
    rows = rules.join(files, "rule_id", "left").join(sums, "rule_id", "left").fillna(0, ["eligible", "findings", "files"])
    sure = F.when(F.col("eligible") == 0, "low").when(~F.col("cross_file") & F.col("candidates"), "medium").otherwise("high")
    dense = F.when((F.col("findings") > 10) & (-F.col("top.minus") > 0.5 * F.col("findings")), F.col("top.path"))
    return rows.select("rule_id", "eligible", "findings", "files", sure.alias("confidence"), dense.alias("densest_file"))
