"""Audits that remember: findings are stored by what a file is, and only new files are read.

A file's *print* is the digest of its path and source; a store is for one set of rules (their
ids and what they say of themselves). An audit anti-joins the files with the prints that the store knows,
parses and audits the rest, and adds their findings; the findings of all files then come from
the store, in a join by print. Findings are written first, under the name of a run, and the
manifest that makes them count last: a run that fails leaves nothing that is read.

Rules that look at several files are left out, as a file's print does not tell what others
hold. Null sources count as empty. Files of equal path and source share a print.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.registry import RULES
from .audit import audit, tables

#: Rules that need a whole project.
CROSS_FILE = ["aria/live-region-missing-on-innerhtml-target", "keyboard/interactive-div-role-missing", "keyboard/handler-missing"]
MANIFEST = "print string, rules string, run string"
FINDING = "print string, line int, col int, rule_id string, criteria array<string>, severity string, fix_class string, message string, finding_id string"


def rule_set(ids: list[str]) -> str:
    """Names a set of rules by their ids and metadata."""
    about = [[i, RULES[i].severity, list(RULES[i].criteria), RULES[i].fix_class] for i in sorted(ids)]
    return hashlib.sha256(json.dumps(about).encode()).hexdigest()[:16]


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of a folder, none where it is not there yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(schema).parquet(folder) if there else spark.createDataFrame([], schema)


def printed(files: DataFrame) -> DataFrame:
    return files.withColumn("print", F.sha2(F.concat(F.coalesce("path", F.lit("")), F.lit("\0"), F.coalesce("source", F.lit(""))), 256))


def unknown(files: DataFrame, folder: str, ids: list[str] | None = None) -> DataFrame:
    """The files that a store holds no result for, one of each print."""
    ids = [i for i in (ids or RULES) if i not in CROSS_FILE]
    known = _read(files.sparkSession, f"{folder}/manifest", MANIFEST).filter(F.col("rules") == rule_set(ids)).select("print").distinct()
    return printed(files).dropDuplicates(["print"]).join(known, "print", "left_anti")


def audit_known(files: DataFrame, folder: str, ids: list[str] | None = None) -> DataFrame:
    """``audit`` of ``files`` (file_id, path, source) with the store in ``folder``."""
    spark, ids = files.sparkSession, [i for i in (ids or sorted(RULES)) if i not in CROSS_FILE]
    rules, run = rule_set(ids), uuid.uuid4().hex
    new = unknown(files, folder, ids).persist()
    if not new.isEmpty():
        with tables(new.drop("print")) as t:
            found = audit(new.drop("print"), ids, t).join(new.select("file_id", "print"), "file_id").drop("file_id", "path")
            found.select([f.split()[0] for f in FINDING.split(", ")]).write.parquet(f"{folder}/findings/run={run}")
        new.select("print", F.lit(rules).alias("rules"), F.lit(run).alias("run")).write.mode("append").parquet(f"{folder}/manifest")
    new.unpersist()
    valid = _read(spark, f"{folder}/manifest", MANIFEST).filter(F.col("rules") == rules).select("run").distinct()
    stored = _read(spark, f"{folder}/findings", FINDING + ", run string").join(valid, "run", "left_semi").drop("run")
    return printed(files).select("file_id", "path", "print").join(stored, "print").drop("print")
