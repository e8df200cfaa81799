"""Unified diffs as changed line ranges, and files of a folder tree."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scope import matches

_HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@")
IGNORED = ["node_modules", ".git", ".hg", "dist", "build", "coverage", ".next", ".cache", "vendor", "target"]


def hunks(diff: str) -> list[tuple[str, int, int]]:
    """(path, first and last line) of what a diff adds or changes; deletions alone give none."""
    out, path = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].strip().strip('"')
            path = None if name == "/dev/null" else name.removeprefix("b/")
        elif path and (m := _HUNK.match(line)):
            start, n = int(m[1]), int(m[2] or 1)
            if n:
                out.append((path, start, start + n - 1))
    return out


def read_hunks(diffs: DataFrame) -> DataFrame:
    """``diffs`` (diff) -> path, start, stop. Null diffs give none."""

    def run(batches):
        for batch in batches:
            rows = [h for d in batch.column(0).to_pylist() for h in hunks(d or "")]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int32()), strict=True)], names=["path", "start", "stop"])

    return diffs.select("diff").mapInArrow(run, "path string, start int, stop int")


def scan_folder(spark: SparkSession, root: str, globs: list[str] | None = None, ignored: list[str] | None = None) -> DataFrame:
    """file_id, path (below ``root``) and source of the text files of a tree, without
    ignored folders and what the globs leave out. Spark lists and reads the files."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").split("://")[-1].removeprefix("file:"))
    path = F.regexp_replace("path", rf"^[a-z0-9]+:/*?(?=/){base}/|^file:{base}/", "")
    rows = rows.select(path.alias("path"), F.decode("content", "UTF-8").alias("source"))
    rows = rows.filter(~F.exists(F.split("path", "/"), lambda x: x.isin(ignored or IGNORED)))
    if globs:
        rows = rows.filter(matches(F.col("path"), globs))
    return rows.select(F.xxhash64("path").alias("file_id"), "path", "source")


def scan_paths(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """The named files, also where a scan of the tree would pass them over, but for node_modules and .git."""
    return scan_folder(spark, root, ignored=["node_modules", ".git"]).filter(F.col("path").isin(paths))
